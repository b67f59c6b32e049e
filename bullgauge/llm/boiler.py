"""Lines repeated across one source's documents: find them and take them out.

Method: the documents of each line are kept as compressed bitmaps per source: one container per (source, line, variant of
the line, bucket of 65,536 ids), a sorted array while it is sparse, runs or a plain bitmap once that is smaller. A variant is
the line as stored, where repair changed it. Each task builds the containers of its own documents before the shuffle; the
containers of one line are then united over tasks and variants, bucket by bucket. The exact cardinalities of these unions, and
nothing else, are held against the thresholds. A line of a document is deleted if the document's low 16 bits are found in
the container of (source, line, bucket).

Skew: a line of a third of all documents is a few containers per task and bucket when it is shuffled, at most 8 kB each; the
look-up is spread by bucket, so a group never holds more than 65,536 documents. While a line's containers pass, only those of one bucket
are in memory, or, until ``min_docs`` is reached, some of fewer than ``min_docs`` documents together.

Defined results: null or blank texts and blank lines give no row; a source that is null has no lines;
a line counts once per document; line numbers count line feeds in the stored text, from 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bullgauge.llm import repair
from bullgauge.llm.shared import small, written

MIN_DOCS, MIN_SHARE = 5, 0.06
_HALF = 1 << 63
#: Lines of which a task makes containers at once.
_ROUND = 500_000


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - _HALF


def lines(docs: DataFrame, doc: str, source: str, text: str) -> DataFrame:
    """doc, source, line_no, line (hash of the repaired form), variant (hash of the line as stored, where repair changed it) of every non-blank line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form: dict[str, int] = {}  # forms of lines seen in this task; cleared before it grows large
        for b in batches:
            ids, sources = (b.column(i).to_pylist() for i in (0, 1))
            rows: tuple[list, ...] = ([], [], [], [], [])
            for d, s, t in zip(ids, sources, b.column(2).to_pylist(), strict=True):
                if not t:
                    continue
                if len(form) > 200_000:
                    form.clear()
                new = repair.comparable(t)
                raw = t.split("\n") if new is not t else None
                for k, line in enumerate(new.split("\n")):
                    h = form.get(line)
                    if h is None:
                        f = repair.line_form(line)
                        h = form[line] = _hash(f) if f else _HALF
                    if h == _HALF:
                        if raw is None or not raw[k].strip():
                            continue
                        h = _hash(f"\0{d}\0{k}")  # markup only: a line of its own
                    rows[0].append(d)
                    rows[1].append(s)
                    rows[2].append(k)
                    rows[3].append(h)
                    rows[4].append(h if raw is None or raw[k] == line else _hash(raw[k]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc", "source", "line_no", "line", "variant"])

    ready = docs.filter(F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("long"), F.col(source).cast("long"), text)
    return ready.mapInArrow(run, "doc long, source long, line_no int, line long, variant long")


# ------------------------------------------------------------------ containers
def pack(low: np.ndarray) -> bytes:
    """Sorted distinct ids below 65,536 -> container: array, runs or bitmap, whichever is smallest."""
    low = low.astype("<u2")
    cuts = np.flatnonzero(np.diff(low.astype(np.int32)) != 1) + 1
    starts = low[np.r_[0, cuts]] if low.size else low
    ends = low[np.r_[cuts - 1, low.size - 1]] if low.size else low
    array, runs = b"A" + low.tobytes(), b"R" + np.stack([starts, ends]).astype("<u2").tobytes()
    best = min(array, runs, key=len)
    if len(best) > 8193:
        bits = np.zeros(65_536, np.uint8)
        bits[low] = 1
        best = b"B" + np.packbits(bits).tobytes()
        packed = b"Z" + zlib.compress(best[1:], 1)
        best = min(best, packed, key=len)
    return best


def unpack(c: bytes) -> np.ndarray:
    kind, data = c[:1], c[1:]
    if kind == b"A":
        return np.frombuffer(data, "<u2")
    if kind == b"R":
        starts, ends = np.frombuffer(data, "<u2").reshape(2, -1).astype(np.int32)
        return np.concatenate([np.arange(a, b + 1) for a, b in zip(starts, ends, strict=True)]).astype("<u2") if starts.size else starts.astype("<u2")
    if kind == b"Z":
        data = zlib.decompress(data)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype("<u2")


def union(a: bytes, b: bytes) -> bytes:
    return pack(np.union1d(unpack(a), unpack(b)))


def _arrays(low: np.ndarray, size: np.ndarray) -> pa.Array:
    """Array containers of consecutive groups of ids, all made at once."""
    ends = np.cumsum(2 * size + 1)
    data = np.full(int(ends[-1]) if ends.size else 0, ord("A"), np.uint8)
    body = np.ones(data.size, bool)
    body[np.r_[0, ends[:-1]] if ends.size else ends] = False
    data[body] = low.astype("<u2").view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), size.size, [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


_PART = pa.schema([("source", pa.int64()), ("line", pa.int64()), ("variant", pa.int64()), ("bucket", pa.int64()), ("bitmap", pa.binary()), ("cardinality", pa.int32())])


def _containers(doc: np.ndarray, source: np.ndarray, line: np.ndarray, variant: np.ndarray) -> Iterator[pa.RecordBatch]:
    bucket, low = doc >> 16, (doc & 65_535).astype(np.uint16)
    order = np.lexsort((low, bucket, variant, line, source))
    keys, low = [c[order] for c in (source, line, variant, bucket)], low[order]
    begins = np.r_[True, np.any([c[1:] != c[:-1] for c in keys], axis=0)]
    once = begins | np.r_[True, low[1:] != low[:-1]]  # a document that has the line twice counts once
    keys, low, begins = [c[once] for c in keys], low[once], begins[once]
    starts = np.flatnonzero(begins)
    size = np.diff(np.r_[starts, low.size])
    few = size <= 16
    yield pa.record_batch([*(pa.array(c[starts[few]]) for c in keys), _arrays(low[np.repeat(few, size)], size[few]), pa.array(size[few].astype(np.int32))], schema=_PART)
    many = np.flatnonzero(~few)
    packed = [pack(low[starts[k] : starts[k] + size[k]]) for k in many]
    yield pa.record_batch([*(pa.array(c[starts[many]]) for c in keys), pa.array(packed, pa.binary()), pa.array(size[many].astype(np.int32))], schema=_PART)


_PARTIAL = "source long, line long, variant long, bucket long, bitmap binary, cardinality int"


def _in_rounds(rows: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    n = 0
    for r in rows:
        held.append(r)
        n += r[0].size
        if n >= _ROUND:
            yield from _containers(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield from _containers(*map(np.concatenate, zip(*held, strict=True)))


def partial(found: DataFrame) -> DataFrame:
    """source, line, variant, bucket, bitmap, cardinality: the containers of each task's documents. found: doc, source, line, variant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_rounds([b.column(i).to_numpy() for i in range(4)] for b in batches)

    return found.select("doc", "source", "line", "variant").mapInArrow(run, _PARTIAL)


def partial_of_lists(docs: DataFrame) -> DataFrame:
    """The same of doc, source, lines (an array; 0 for a blank line), where the variants of a line are not told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list[np.ndarray]]:
            for b in batches:
                lists = b.column(2)
                size = lists.value_lengths().fill_null(0).to_numpy()
                line = lists.flatten().to_numpy()
                doc, source = (np.repeat(b.column(i).to_numpy(), size)[line != 0] for i in (0, 1))
                line = line[line != 0]
                yield [doc, source, line, line]

        yield from _in_rounds(rows())

    return docs.select("doc", "source", "lines").filter("source IS NOT NULL").mapInArrow(run, _PARTIAL)


_WHOLE = pa.schema([("source", pa.int64()), ("line", pa.int64()), ("bucket", pa.int64()), ("bitmap", pa.binary()), ("cardinality", pa.int64()), ("variants", pa.int32())])


def united(parts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """source, line, bucket, bitmap, cardinality, variants of the lines whose united bitmaps hold at least ``min_docs`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line: tuple[int, int] | None = None
        bucket, total = 0, 0
        variants: dict[int, bytes] = {}
        held: list[tuple] = []
        out: list[tuple] = []

        def close_bucket() -> None:
            nonlocal total
            if variants:
                whole = reduce(union, variants.values())
                n = int(unpack(whole).size)
                held.append((*line, bucket, whole, n, len(variants)))
                total += n
                variants.clear()
            if total >= min_docs:
                out.extend(held)
                held.clear()

        def close_line() -> None:
            nonlocal total
            close_bucket()
            held.clear()
            total = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 6
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _WHOLE, strict=True)], schema=_WHOLE)

        for b in batches:
            if not b.num_rows:
                continue
            source, text, variant, at = (b.column(i).to_numpy() for i in range(4))
            begins = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (text[1:] != text[:-1])])
            most = np.add.reduceat(b.column(5).to_numpy().astype(np.int64), begins)  # the union holds no more than its parts
            most[[0, -1]] = min_docs  # lines that go on in another batch
            bitmaps = b.column(4)
            for a, z in zip(begins[most >= min_docs], np.r_[begins[1:], b.num_rows][most >= min_docs], strict=True):
                if line != (int(source[a]), int(text[a])):
                    close_line()
                    line = int(source[a]), int(text[a])
                for k in range(a, z):
                    if variants and bucket != at[k]:
                        close_bucket()
                    bucket, v, c = int(at[k]), int(variant[k]), bitmaps[k].as_py()
                    variants[v] = union(variants[v], c) if v in variants else c
            yield flush()
        close_line()
        yield flush()

    rows = parts.repartition("source", "line").sortWithinPartitions("source", "line", "bucket", "variant")
    return rows.mapInArrow(run, "source long, line long, bucket long, bitmap binary, cardinality long, variants int")


def repeated(found: DataFrame, docs_per_source: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``often`` of the containers of found (doc, source, line, variant)."""
    return often(partial(found), docs_per_source, min_docs, min_share)


def often(parts: DataFrame, docs_per_source: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """source, line, bucket, bitmap, docs, variants: the containers of the lines whose united bitmaps hold at least ``min_docs`` documents of their source and at least ``min_share`` of them."""
    spark = parts.sparkSession
    maps = written(spark, united(parts, min_docs), "bitmaps")
    docs = maps.groupBy("source", "line").agg(F.sum("cardinality").alias("docs"), F.max("variants").alias("variants"))
    enough = F.greatest(F.lit(float(min_docs)), F.col("n") * min_share - 1e-9)
    kept = docs.join(small(spark, docs_per_source, "sources"), "source").filter(F.col("docs") >= enough).drop("n")
    return maps.select("source", "line", "bucket", "bitmap").join(small(spark, kept, "often"), ["source", "line"])


def places(found: DataFrame, lines_: DataFrame) -> DataFrame:
    """doc, line_no of every place of a repeated line, by look-up of the document in the bitmap of (source, line, bucket)."""
    group = ["source", "line", "bucket"]
    maps = written(found.sparkSession, lines_.select(*group, "bitmap"), "maps")
    at = found.select("source", "line", F.shiftrightunsigned("doc", 16).alias("bucket"), "doc", "line_no")
    at = at.join(small(found.sparkSession, maps.select(*group), "keys"), group, "left_semi")  # those for which there is a bitmap at all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros(65_536, bool)
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i).to_numpy() for i in range(3)]
            doc = b.column(3).fill_null(-1).to_numpy()
            hit = np.zeros(doc.size, bool)
            begins = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in keys], axis=0)])
            for a, z in zip(begins, np.r_[begins[1:], doc.size], strict=True):
                if key != (own := tuple(int(c[a]) for c in keys)):
                    key = own
                    held[:] = False
                if (c := b.column(5)[a].as_py()) is not None:  # the bitmap comes before its documents
                    held[unpack(c)] = True
                hit[a:z] = (doc[a:z] >= 0) & held[doc[a:z] & 65_535]
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4)], names=["doc", "line_no"]).filter(pa.array(hit))

    none = [F.lit(None).cast("long").alias("doc"), F.lit(None).cast("int").alias("line_no")]
    both = maps.select(*group, *none, "bitmap").unionByName(at.withColumn("bitmap", F.lit(None).cast("binary")))
    both = both.repartition(*group).sortWithinPartitions(*group, F.col("bitmap").isNull())
    return both.mapInArrow(run, "doc long, line_no int")


def without(docs: DataFrame, doc: str, text: str, at: DataFrame) -> DataFrame:
    """doc, text of every document without the lines at the given places; other line ends stay."""
    drop = at.groupBy("doc").agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("drop", i), F.lit(False)))
    return docs.join(drop, docs[doc] == drop["doc"], "left").select(docs[doc].alias("doc"), F.when(F.col("drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias("text"))


def report_lines(spark: SparkSession, reports: DataFrame) -> DataFrame:
    """The lines of the readable reports, written once to the shared folder as two passes read them."""
    return written(spark, lines(reports.filter("parse_status = 'ok'"), "id", "org_id", "parsed_text"), "lines")


def sources(reports: DataFrame) -> DataFrame:
    """Readable reports per house; as many rows as houses."""
    return reports.filter("parse_status = 'ok' AND org_id IS NOT NULL").groupBy(F.col("org_id").alias("source")).agg(F.count("*").alias("n"))
