"""Problems 2, 3 and 5 as operators over a table of texts, and their joint use on single lines.

The Arrow operators stream record batches through Python once; clean texts are told by compiled
patterns and pass as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bullgauge.llm import garble, markup
from bullgauge.llm.lookalike import fold
from bullgauge.llm.shared import written


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def restore_encoding(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, text (restored), garbled for the rows whose text was garbled in places; rows without a garbled piece and null texts give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for k, t in zip(_column(b, key), _column(b, text), strict=True):
                new, hit = garble.repair_text(t)
                if hit:
                    ids.append(k)
                    out.append(new)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["key", "text"])

    return texts.select(key, text).mapInArrow(run, "key long, text string")


_MARKED = "key long, source long, text string, kinds array<string>, paths array<struct<path:string,lines:long,chars:long,punctuation:long,linked:long>>"


def marked(texts: DataFrame, key: str, text: str, source: str | None = None) -> DataFrame:
    """key, source, text (as its nodes are told), kinds, paths (the tag paths of its nodes with their counts) of the rows that have a node of markup; all other rows give none. Garbled pieces are read first, so markup inside them counts too; look-alike characters don't make or hide markup, and the text has them put right only where its nodes are not seen else."""
    shape = pa.list_(pa.struct([("path", pa.string()), *((c, pa.int64()) for c in ("lines", "chars", "punctuation", "linked"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {"key": [], "source": [], "text": [], "kinds": [], "paths": []}
            for k, s, t in zip(_column(b, "key"), _column(b, "source"), _column(b, "text"), strict=True):
                if not t:
                    continue
                t, _ = garble.repair_text(t)
                plain = fold(t)
                found = markup.nodes(plain)
                if markup.is_marked(found):
                    if plain is not t and markup.is_marked(own := markup.nodes(t)):
                        plain, found = t, own
                    counts = markup.statistics(found)
                    for name, x in (("key", k), ("source", s), ("text", plain), ("kinds", markup.dialects(found)), ("paths", [dict(zip(("path", "lines", "chars", "punctuation", "linked"), (p, *c), strict=True)) for p, c in counts.items()])):
                        rows[name].append(x)
            yield pa.record_batch([pa.array(rows["key"], pa.int64()), pa.array(rows["source"], pa.int64()), pa.array(rows["text"], pa.string()), pa.array(rows["kinds"], pa.list_(pa.string())), pa.array(rows["paths"], shape)], names=list(rows))

    of = F.lit(None) if source is None else F.col(source)
    return texts.select(F.col(key).cast("long").alias("key"), of.cast("long").alias("source"), F.col(text).alias("text")).mapInArrow(run, _MARKED)


def no_content(paths: DataFrame, share: float = markup.SHARE) -> DataFrame:
    """source, path of the paths whose ratio is too low, from (source, path, lines, chars, punctuation, linked): ``markup.content_paths`` over all documents of a source, as joins of each path with the sums over its parent, children and siblings."""
    fields = ("lines", "chars", "punctuation", "linked")
    sums = paths.groupBy("source", "path").agg(*(F.sum(c).alias(c) for c in fields))
    up = F.regexp_replace("path", "/?[^/]*$", "")
    one = sums.select("source", "path", up.alias("up"), "lines", (F.col("chars") / F.col("lines")).alias("length"), (F.col("punctuation") / F.col("lines")).alias("marks"), (F.col("linked") / F.col("chars")).alias("linked"))
    one = written(paths.sparkSession, one, "paths")
    below = one.groupBy("source", "up").agg(F.count("*").alias("n"), F.sum("length").alias("s_length"), F.sum("marks").alias("s_marks"))
    p, b1, b2, top = one.alias("p"), below.alias("beside"), below.alias("below"), one.alias("top")
    rows = p.join(b1, F.expr("p.source <=> beside.source AND p.up = beside.up")).join(b2, F.expr("p.source <=> below.source AND p.path = below.up"), "left").join(top, F.expr("p.source <=> top.source AND p.up = top.path"), "left")

    def smooth(c: str):
        n_below, s_below = F.coalesce("below.n", F.lit(0)), F.coalesce(f"below.s_{c}", F.lit(0.0))
        has_top = F.when(F.col("top.path").isNotNull(), markup.NEAR).otherwise(0.0)
        total = F.col(f"p.{c}") + markup.FAR * (F.col(f"beside.s_{c}") - F.col(f"p.{c}")) + markup.NEAR * s_below + has_top * F.coalesce(f"top.{c}", F.lit(0.0))
        return total / (1 + markup.FAR * (F.col("beside.n") - 1) + markup.NEAR * n_below + has_top)

    rows = rows.select("p.source", "p.path", "p.lines", markup.ratio(smooth("length"), smooth("marks"), F.col("p.linked")).alias("ratio"))
    mean = rows.groupBy("source").agg((F.sum(F.col("ratio") * F.col("lines")) / F.sum("lines")).alias("mean"))
    low = rows.alias("r").join(mean.alias("m"), F.expr("r.source <=> m.source")).filter(F.col("ratio") < share * F.col("mean")).select("r.source", "path")
    open_ = F.udf(lambda x: markup.exempt(x) is None, "boolean", useArrow=True)  # one call for each path of a source, not of a document
    return low.filter(open_("path"))


def strip_markup(texts: DataFrame, key: str, text: str, source: str | None = None) -> DataFrame:
    """key, text (plain, structure kept), kinds of the rows that have markup; all other rows give none. Which tag paths are content is told from all documents of their source."""
    spark = texts.sparkSession
    rows = written(spark, marked(texts, key, text, source), "marked")
    at = rows.select("key", "source", F.inline("paths"))
    low = written(spark, no_content(at.drop("key")), "low")
    gone = at.alias("a").join(low.alias("l"), F.expr("a.source <=> l.source AND a.path = l.path"), "left_semi").groupBy("key").agg(F.collect_set("path").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [markup.plain_text(t, dropped=g or ()) for t, g in zip(_column(b, "text"), _column(b, "gone"), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(new, pa.string()), b.column(2)], names=["key", "text", "kinds"])

    return rows.join(gone, "key", "left").select("key", "text", "kinds", "gone").mapInArrow(run, "key long, text string, kinds array<string>")


def comparable(text: str) -> str:
    """A text with problems 2, 3 and 5 put right and every line where it stood."""
    new, _ = garble.repair_text(text)
    new = fold(new)
    plain = markup.plain_text(new, marks=False)  # the same object where there is no markup
    return new if plain is new else fold(plain)


@lru_cache(1)
def _digits() -> re.Pattern:
    return re.compile(r"\d+")


def line_form(line: str) -> str:
    """What makes two lines the same: no white space at the ends, every run of digits alike."""
    return _digits().sub("0", line.strip())
