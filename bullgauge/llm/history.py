"""New batches against all history: which documents repeat an earlier one, exactly or nearly.

Method: multi-key sorted-neighbourhood runs. Every document has several sort keys: the hash of its
file, the hash of its body, and ``KEYS`` keys of eight one-byte minimums each (minimum hashes of its runs of ``RUN`` characters).
The keys of a batch are sorted within key ranges and persisted as a run; a new run is merged with
the persisted runs of each range, and only the windows around its records are compared: neighbours up to
``WINDOW`` places away that share the first ``PREFIX`` bytes of the key and ``REST`` of the other
13: each record carries the document's next key as a check, or a second hash of its file or body; equal files and bodies are told by both hashes. After every ``COMPACT`` batches the
runs of a range are merged into one. Candidates are verified exactly on their bodies. Where a bucket
(equal key number and ``PREFIX`` bytes) holds more than a window reaches, ``crowded`` goes on after the last batch with
all pairs of the bucket: as candidates where few pass the bytes, else the bucket's bodies are brought together and compared by ``alike_in_crowds``.

Scale: documents with the same file or body are one record of the run (the first of them; the others are linked to it by a
pre-aggregated minimum), so a group of copies that holds a third of all rows is one entry in every
key range. A batch reads keys of 24 bytes of the history, never its texts, but for the candidates. A batch's candidates
are few: two documents with a sixth of their runs in common become one in 3,000 times, those that repeat each other at 0.65 in 99 of 100. A bucket gives at most ``WINDOW`` candidates for
each of its records; one with more is sent as records with a body each, in tiles of two blocks of ``BLOCK`` records, so its memory is bounded; its time grows with the square of the bucket.

Defined results: a null or empty body has no body keys, a null file hash no file key; bodies of fewer than ``RUN``
characters are compared by hash only; ties go to the smaller id; an empty batch adds an empty run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bullgauge.llm import shared
from bullgauge.llm.shared import shared_dir, written

RUN, SIMILAR = 5, 0.6
KEYS, PREFIX, REST, WINDOW, COMPACT = 16, 3, 6, 8, 4
BINS = KEYS * 8
FILE, BODY, NEAR = 0, 1, 2  # numbers of the keys
BLOCK = 8_000  # records of a bucket compared at once with as many others
BITS = 4_096  # of the presence map of a body's runs
#: Bounded broadcast of candidate ids (8 bytes each); beyond it they are joined by shuffle.
MOST_IDS = 4_000_000


# ------------------------------------------------------------------ one document
def shingles(body: str) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of RUN characters, sorted."""
    c = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if c.size < RUN:
        return np.zeros(0, np.uint64)
    h = c[: c.size - RUN + 1].copy()
    for k in range(1, RUN):
        h = h * np.uint64(0x100000001B3) + c[k : c.size - RUN + 1 + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


_EDGES = (np.arange(BINS, dtype=np.float64) * 2.0**64 / BINS).astype(np.uint64)
_ORDER = [np.random.default_rng(s).permutation(BINS) for s in range(16)]


def near_keys(h: np.ndarray) -> np.ndarray:
    """KEYS sort keys from one pass: the hashes are cut into BINS ranges, each range's minimum is one of the minimum hashes; an empty range borrows from another by fixed permutations."""
    at = np.searchsorted(h, _EDGES)
    end = np.r_[at[1:], h.size]
    full = at < end
    low = np.zeros(BINS, np.uint64)
    low[full] = h[at[full]]
    for p in _ORDER:
        if full.all():
            break
        take = ~full & full[p]
        low[take] = low[p][take] * np.uint64(0x9E3779B97F4A7C15)
        full |= take
    low ^= low >> np.uint64(33)
    low *= np.uint64(0xFF51AFD7ED558CCD)
    return (low >> np.uint64(56)).astype(np.uint8).reshape(KEYS, 8).copy().view(">u8").astype(np.uint64).ravel().view(np.int64)


def similarity(a: str, b: str) -> float:
    """Distinct runs found in both, of those found in either."""
    if a == b:
        return 1.0 if a else 0.0
    x, y = ({t[i : i + RUN] for i in range(len(t) - RUN + 1)} for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def squeeze(body: str) -> str:
    return "".join(body.split())


# ------------------------------------------------------------------ keys of a batch
_KEYED = pa.schema([("id", pa.int64()), ("batch_no", pa.int32()), ("file_key", pa.int64()), ("file_check", pa.int64()), ("body_key", pa.int64()), ("body_check", pa.int64()), ("near_keys", pa.list_(pa.int64()))])


def _twice(s: str) -> tuple[int, int]:
    """Two hashes; texts that share both are taken for equal."""
    return tuple(xxhash.xxh3_64_intdigest(s, seed=k) - (1 << 63) for k in (0, 1))


def keyed(rows: DataFrame, body_of: Callable[[pa.RecordBatch], list[str | None]]) -> DataFrame:
    """id, batch_no, file_key, file_check, body_key, body_check, near_keys; rows: id, batch_no, file hash, then what body_of needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, bodies, near = [], [], []
            for f, body in zip(b.column(2).to_pylist(), body_of(b), strict=True):
                files.append(_twice(f.strip().lower()) if f and f.strip() else (None, None))
                body = squeeze(body) if body else ""
                h = shingles(body)
                bodies.append(_twice(body) if body else (None, None))
                near.append(near_keys(h) if h.size else None)
            cols = [[x[k] for x in pairs] for pairs in (files, bodies) for k in (0, 1)]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols), pa.array(near, pa.list_(pa.int64()))], schema=_KEYED)

    return rows.mapInArrow(run, "id long, batch_no int, file_key long, file_check long, body_key long, body_check long, near_keys array<long>")


def _exact(batch: DataFrame) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(number).alias("key_no"), F.col(f"{name}_key").alias("key"), F.col(f"{name}_check").alias("check")) for number, name in ((FILE, "file"), (BODY, "body"))))
    return batch.select("id", "batch_no", F.inline(kinds)).filter("key IS NOT NULL")


def copies(batch: DataFrame) -> DataFrame:
    """a, b, key_no of every document of a batch that has the file or body of an earlier one in the same batch; a is the first such. A group is joined with its one first document, so it may be of any size; no text is read."""
    rows = _exact(batch)
    firsts = rows.groupBy("batch_no", "key_no", "key", "check").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(firsts, ["batch_no", "key_no", "key", "check"]).filter("id > a").select("a", F.col("id").alias("b"), "key_no")


class History:
    """Persisted runs of everything accepted. ``splits`` cuts each key's values into so many ranges (a power of two), for tasks of bounded size; it stays for the life of the history."""

    def __init__(self, spark: SparkSession, splits: int = 1, path: str | None = None):
        self.spark, self.splits = spark, splits
        self.path = path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
        if not path:
            shared._MADE.append(self.path)  # a history without a place of its own lasts as long as the job
        self.runs: list[str] = []
        self.ranges = (KEYS + 2) * splits
        self.added = self.written = 0

    def _next(self) -> str:
        self.written += 1
        return f"{self.path}/runs/run={self.written}"

    def _range(self):
        bits = self.splits.bit_length() - 1
        part = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
        return F.col("key_no") * self.splits + part

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge a batch of keyed() rows; a, b, key_no of the pairs of its records with their neighbours (a < b), itself included."""
        firsts = _exact(batch).groupBy("key_no", "key", "check").agg(F.min("id").alias("id"))
        # near keys of the first document of each body only
        bodies = batch.filter("body_key IS NOT NULL").groupBy("body_key", "body_check").agg(F.min_by("near_keys", "id").alias("near_keys"), F.min("id").alias("id")).filter("near_keys IS NOT NULL")
        near = bodies.select(F.posexplode("near_keys"), "near_keys", "id").select((F.col("pos") + NEAR).alias("key_no"), F.col("col").alias("key"), F.get("near_keys", (F.col("pos") + 1) % KEYS).alias("check"), "id")
        rows = firsts.select("key_no", "key", "check", "id").unionByName(near).withColumn("range", self._range())
        run = self._next()
        rows.repartition("range").sortWithinPartitions("range", "key_no", "key", "id").write.option("compression", "zstd").partitionBy("range").parquet(run)
        pairs = self._neighbours(run)
        self.runs.append(run)
        self.added += 1
        if self.added % COMPACT == 0:
            self.compact()
        return pairs

    def _neighbours(self, run: str) -> DataFrame:
        old, new = list(self.runs), run

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.column(0).to_pylist():
                    yield _merge(old, new, r)

        todo = self.spark.range(0, self.ranges, 1, min(self.ranges, max(2, self.spark.sparkContext.defaultParallelism)))
        path = f"{self.path}/pairs-{self.added}"
        todo.mapInArrow(compare, "a long, b long, key_no int").write.parquet(path)
        return self.spark.read.schema("a long, b long, key_no int").parquet(path)

    def crowded(self) -> DataFrame:
        """Buckets that hold more than a window reaches, over all batches. a, b of their pairs that pass the bytes, where these are at most WINDOW a record; else (a, key, check, crowd, block, one, two) of every record, once for each tile of blocks one and two."""
        runs = list(self.runs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.column(0).to_pylist():
                    yield from _crowds(runs, r)

        near = (self.ranges - NEAR * self.splits, NEAR * self.splits)
        todo = self.spark.range(near[1], self.ranges, 1, min(near[0], max(2, self.spark.sparkContext.defaultParallelism)))
        path = f"{self.path}/crowds-{self.added}"
        todo.mapInArrow(run, _CROWD).write.parquet(path)
        return self.spark.read.schema(_CROWD).parquet(path)

    def compact(self) -> None:
        """All runs of each range become one sorted run."""
        if len(self.runs) < 2:
            return
        run = self._next()
        rows = self.spark.read.option("basePath", f"{self.path}/runs").schema("key_no int, key long, check long, id long, range int, run int").parquet(*self.runs).drop("run")
        rows.repartition("range").sortWithinPartitions("range", "key_no", "key", "id").write.option("compression", "zstd").partitionBy("range").parquet(run)
        gone, self.runs = self.runs, [run]
        for p in gone:
            f, at = fs.FileSystem.from_uri(p)
            f.delete_dir(at)


def _read(run: str, r: int) -> tuple[np.ndarray, ...]:
    f, at = fs.FileSystem.from_uri(run)
    found = [x.path for x in f.get_file_info(fs.FileSelector(f"{at}/range={r}", allow_not_found=True)) if x.base_name.startswith("part-")]
    tables = [pq.ParquetFile(f.open_input_file(p)).read(["key_no", "key", "check", "id"]) for p in found]
    if not tables:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    t = pa.concat_tables(tables)
    return tuple(t.column(c).to_numpy() for c in ("key_no", "key", "check", "id"))


def _merge(old: list[str], new: str, r: int) -> pa.RecordBatch:
    """Merge the new run of a range into the old ones and compare the windows around its records."""
    number, key, check, doc = _read(new, r)
    a = b = np.zeros(0, np.int64)
    kinds = np.zeros(0, np.int32)
    if key.size:
        parts = [_read(p, r) for p in old]
        number0, key0, check0, doc0 = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
        fresh = np.r_[np.zeros(key0.size, bool), np.ones(key.size, bool)]
        number, doc = np.r_[number0, number], np.r_[doc0, doc].astype(np.int64)
        key, check = (np.r_[x, y].astype(np.int64).view(np.uint64) for x, y in ((key0, key), (check0, check)))
        order = np.lexsort((doc, key, number))
        number, key, check, doc, fresh = number[order], key[order], check[order], doc[order], fresh[order]
        got: list[tuple[np.ndarray, ...]] = []
        shift = np.uint64(8 * (8 - PREFIX))
        for d in range(1, WINDOW + 1):
            one, two = slice(0, max(0, key.size - d)), slice(d, None)
            near = number[two] >= NEAR
            other = key[one] ^ key[two]
            hit = np.flatnonzero(np.where(near, other >> shift == 0, other == 0) & (number[one] == number[two]) & (fresh[one] | fresh[two]) & (doc[one] != doc[two]))
            if hit.size:  # of those, look at all bytes
                checks = check[hit] ^ check[hit + d]
                both = np.stack([other[hit], checks], 1).view(np.uint8)
                hit = hit[np.where(number[hit + d] < NEAR, checks == 0, (both == 0).sum(1) >= PREFIX + REST)]
            got.append((np.minimum(doc[hit], doc[hit + d]), np.maximum(doc[hit], doc[hit + d]), number[hit]))
        a, b, kinds = (np.concatenate([g[k] for g in got]) for k in range(3))
        kinds = np.minimum(kinds, NEAR)
        if a.size:
            a, b, kinds = np.unique(np.stack([a, b, kinds.astype(np.int64)]), axis=1)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kinds.astype(np.int32), pa.int32())], names=["a", "b", "key_no"])


# ------------------------------------------------------------------ crowded buckets
_CROWD = "a long, b long, key long, check long, crowd long, block int, one int, two int"
_CHUNK = 200_000


def _rows(**cols: np.ndarray) -> pa.RecordBatch:
    n = next(iter(cols.values())).size
    names = [c.split() for c in _CROWD.split(", ")]
    return pa.record_batch([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in ((c, pa.int64() if t == "long" else pa.int32()) for c, t in names)], names=[c for c, _ in names])


def _bytes(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """16 rows: the bytes of the key and of the check."""
    return np.ascontiguousarray(np.stack([key, check], 1).astype(np.int64).view(np.uint8).T)


def _like(m: np.ndarray, k: int, end: int) -> np.ndarray:
    """Records before ``end`` that share PREFIX + REST bytes with record k of the same bucket."""
    return np.flatnonzero((m[:, :end] == m[:, k : k + 1]).sum(0, dtype=np.uint8) >= PREFIX + REST)


def _crowds(runs: list[str], r: int) -> Iterator[pa.RecordBatch]:
    parts = [_read(p, r) for p in runs]
    number, key, check, doc = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(4))
    if not key.size:
        return
    bucket = (number << np.int64(8 * PREFIX)) | (key.view(np.uint64) >> np.uint64(8 * (8 - PREFIX))).view(np.int64)
    order = np.lexsort((doc, bucket))
    key, check, doc, bucket = key[order], check[order], doc[order], bucket[order]
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, bucket.size]
    got: list[np.ndarray] = []
    held = 0
    for x, z in zip(cuts[:-1], cuts[1:], strict=True):
        n = int(z - x)
        if n <= WINDOW + 1:  # the window met all of them
            continue
        m, own, count = _bytes(key[x:z], check[x:z]), [], 0
        for k in range(1, n):
            like = _like(m, k, k)
            if like.size:
                own.append(np.stack([doc[x:z][like], np.full(like.size, doc[x + k])]))
                count += like.size
                if count > WINDOW * n:
                    break
        if count <= WINDOW * n:
            got += own
            held += count
            if held >= _CHUNK:
                a, b = np.concatenate(got, axis=1)
                yield _rows(a=a, b=b)
                got, held = [], 0
            continue
        blocks = -(-n // BLOCK)
        for i in range(blocks):
            part = slice(x + i * BLOCK, min(z, x + (i + 1) * BLOCK))
            for j in range(blocks):
                whole = [np.full(part.stop - part.start, v) for v in (bucket[x], i, min(i, j), max(i, j))]
                yield _rows(a=doc[part], key=key[part], check=check[part], crowd=whole[0], block=whole[1], one=whole[2], two=whole[3])
    if got:
        a, b = np.concatenate(got, axis=1)
        yield _rows(a=a, b=b)


def _tile(ids: list[int], m: np.ndarray, blocks: np.ndarray, bodies: list[str], similar: float) -> Iterator[tuple[int, int]]:
    """Links of a tile's records (in order of the id). A pair is left out only where it cannot be similar (at most so many runs in common by the presence maps), or where the later already reaches the earlier by links found."""
    n, sets = len(ids), [shingles(t) for t in bodies]
    size = np.array([h.size for h in sets], np.int64)
    maps, reach = np.zeros((n, BITS // 64), np.uint64), np.zeros((n, (n + 7) // 8), np.uint8)
    for k, h in enumerate(sets):
        bits = np.zeros(BITS, np.uint8)
        bits[(h % np.uint64(BITS)).astype(np.int64)] = 1
        maps[k] = np.packbits(bits).view(np.uint64)
    del sets
    more = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
    cross = blocks[0] != blocks[-1] or (blocks != blocks[0]).any()
    for k in range(1, n):
        like = _like(m, k, k)
        if cross:
            like = like[blocks[like] != blocks[k]]
        while like.size:
            some, like = like[-64:], like[:-64]  # the nearest first, they often reach the rest
            both = np.bitwise_count(maps[some] & maps[k]).sum(1, dtype=np.int64) + np.minimum(more[some], more[k])
            some = some[both * (1 + similar) >= similar * (size[some] + size[k]) - 1e-6]
            linked = False
            while some.size:
                a, some = int(some[-1]), some[:-1]
                if similarity(bodies[a], bodies[k]) >= similar:
                    yield ids[a], ids[k]
                    linked = True
                    reach[k] |= reach[a]
                    reach[k, a >> 3] |= 1 << (a & 7)
                    some = some[(reach[k, some >> 3] >> (some & 7)) & 1 == 0]
            if linked:
                like = like[(reach[k, like >> 3] >> (like & 7)) & 1 == 0]


def alike_in_crowds(records: DataFrame, bodies: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """a, b: links between the records of each crowded bucket, enough that every similar pair of it is linked, directly or down through others. records: those of crowded() with a crowd; bodies: id, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: tuple | None = None
        rows: list[tuple] = []

        def links() -> Iterator[pa.RecordBatch]:
            ids, key, check, blocks, texts = zip(*rows, strict=True)
            got = []
            for pair in _tile(list(ids), _bytes(np.array(key), np.array(check)), np.array(blocks), list(texts), similar):
                got.append(pair)
                if len(got) == _CHUNK:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["a", "b"])
                    got = []
            if got:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["a", "b"])

        for x in batches:
            cols = [x.column(k).to_pylist() for k in range(8)]
            for crowd, one, two, *row, body in zip(*cols, strict=True):
                if tile != (crowd, one, two) and rows:
                    yield from links()
                    rows.clear()
                tile = crowd, one, two
                rows.append((*row, squeeze(body)))
        if rows:
            yield from links()

    both = records.withColumnRenamed("a", "id").drop("b").join(bodies, "id").select("crowd", "one", "two", "id", "key", "check", "block", "body")
    both = both.repartition("crowd", "one", "two").sortWithinPartitions("crowd", "one", "two", "id")
    return both.mapInArrow(run, "a long, b long")


# ------------------------------------------------------------------ verification and links
def verified(pairs: DataFrame, bodies: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs whose bodies are similar. bodies: id, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = [similarity(squeeze(p), squeeze(q)) >= similar for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
    both = left.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
    return both.select("a", "b", "body_a", "body_b").mapInArrow(run, "a long, b long")


def first_of_all(spark: SparkSession, links: DataFrame) -> DataFrame:
    """b, a: the smallest document that b repeats, directly or by way of others. Minimal labels over the links (a < b), with a jump over the label's own label in each round, so rounds grow with the logarithm of a chain."""
    links = written(spark, links.distinct(), "links")
    label = written(spark, links.groupBy("b").agg(F.min("a").alias("a")), "label")
    while True:
        over = label.select(F.col("b").alias("a"), F.col("a").alias("to"))
        step = links.join(over, "a", "left").select("b", F.coalesce("to", "a").alias("a"))
        jump = label.join(over, "a", "left").select("b", F.coalesce("to", "a").alias("a"))
        new = written(spark, step.unionByName(jump).groupBy("b").agg(F.min("a").alias("a")), "label")
        if not new.join(label, ["b", "a"], "left_anti").limit(1).count():
            return new
        label = new
