"""One mixture of several sources with target shares of its tokens.

Method: subset-sum budget fitting. Documents are counted by exact token length per source. Of a source's budget, whole
passes over the source come first; of what is left each length gives its proportional number of documents; the last remainder
is fitted by dynamic programming over the lengths with their numbers as bounds; then so many documents
of each length are taken in seeded order.

The total is a parameter; by default it is the largest at which every listed source that has documents reaches its
share without a document occurring more than ``max_repeats`` times. At a larger total a source that
runs out gives all it may.

Scale: the fit sees (source, length, count) rows, grouped by source; the documents are ranked within
(source, length, one of 256 ranges of a seeded hash), so a source with a third of all documents or a length that
very many have is spread over tasks. Nothing is collected.

Defined results: a document without tokens (null, empty) is in no mixture; a null or unlisted source is left out; a
listed source without documents reaches share 0; repeated targets of a source count once (the least).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, each at most once, so that the tokens come as near to the budget as possible from below."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts
    take = counts * max(budget, 0) // max(total, 1)
    left = budget - int((lengths * take).sum())
    for k in np.argsort(-lengths):  # the proportional part is rounded down: fill up with single documents, longest first
        more = min(int(counts[k] - take[k]), left // int(lengths[k]))
        take[k] += more
        left -= more * int(lengths[k])
    if left:  # free some short documents again and fit what then remains exactly
        free = np.zeros_like(take)
        room = 4 * int(lengths.max()) + left
        for k in np.argsort(lengths):
            free[k] = min(int(take[k]), max(0, (room - left)) // int(lengths[k]))
            left += int(free[k]) * int(lengths[k])
            if left >= room:
                break
        take -= free
        take += knapsack(lengths, counts - take, left)
    return take


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: counts taken, with the largest sum up to the budget. The set of reachable sums is the bits of one whole number; of each sum only the item that reached it first is kept, as it is enough to go back by. Bounds are split into powers of two."""
    items = []
    for k, (length, c) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        c, p = min(c, budget // length), 1
        while c > 0:
            n = min(p, c)
            items.append((k, n, n * length))
            c -= n
            p *= 2
    mask, reach = (1 << budget + 1) - 1, 1
    by = np.full(budget + 1, -1, np.int32)
    for j, (_, _, size) in enumerate(items):
        new = reach << size & mask & ~reach
        if new:
            by[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little"))] = j
            reach |= new
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    take = np.zeros_like(counts)
    while at:  # what an item reached first was reached before without it
        k, n, size = items[by[at]]
        take[k] += n
        at -= size
    return take


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, n_ids, passes (whole passes over the source), take (documents of this length in one more pass)."""
    goal = targets.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    lengths = sized.filter("source IS NOT NULL AND n_ids > 0").groupBy("source", "n_ids").agg(F.count("*").alias("c"))
    lengths = lengths.join(F.broadcast(goal), "source")  # as many rows as there are targets
    stock = lengths.groupBy("source").agg(F.sum(F.col("n_ids") * F.col("c")).alias("stock"), F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"))
    most = stock.agg(F.min(F.col("stock") * F.col("max_repeats") / F.col("target_share")).alias("total")) if total is None else stock.agg(F.lit(float(total)).alias("total"))
    budget = stock.join(F.broadcast(most)).select("source", "stock", F.least(F.floor(F.col("target_share") * F.col("total") + 1e-6), F.col("stock") * F.col("max_repeats")).cast("long").alias("budget"))

    def per_source(rows: pd.DataFrame) -> pd.DataFrame:
        stock, budget = int(rows.stock.iloc[0]), int(rows.budget.iloc[0])
        rows = rows.sort_values("n_ids")
        passes = budget // stock
        take = fit(rows.n_ids.to_numpy(), rows.c.to_numpy(), budget - passes * stock)
        return pd.DataFrame({"source": rows.source, "n_ids": rows.n_ids, "passes": passes, "take": take})

    return lengths.join(F.broadcast(budget), "source").groupBy("source").applyInPandas(per_source, "source string, n_ids long, passes long, take long")


def mix(sized: DataFrame, targets: DataFrame, key: str, total: int | None = None, seed: int = 42) -> DataFrame:
    """key, source, n_ids, copies of every document in the mixture."""
    do = plan(sized, targets, total)
    docs = sized.filter("source IS NOT NULL AND n_ids > 0").withColumn("h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("range", F.shiftrightunsigned("h", 56))
    group = ["source", "n_ids", "range"]
    before = docs.groupBy(*group).agg(F.count("*").alias("c"))
    before = before.withColumn("before", F.sum("c").over(Window.partitionBy("source", "n_ids").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    cut = before.join(do, ["source", "n_ids"]).select(*group, "passes", (F.col("take") - F.coalesce("before", F.lit(0))).alias("rest"))
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("h", key)))
    copies = F.col("passes") + (F.col("rank") <= F.col("rest")).cast("long")
    return ranked.join(cut, group).select(key, "source", "n_ids", copies.alias("copies")).filter("copies > 0")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, documents, tokens, most_copies, share (reached) of every listed source."""
    got = mixture.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_ids") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    got = F.broadcast(targets).join(got, "source", "left").fillna(0, ["documents", "tokens", "most_copies"])
    whole = got.agg(F.sum("tokens").alias("whole"))
    return got.join(F.broadcast(whole)).withColumn("share", F.try_divide(F.col("tokens"), F.col("whole"))).drop("whole")
