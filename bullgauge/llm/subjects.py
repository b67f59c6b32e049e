"""Subject areas of documents by a seeded non-negative factorization.

Method: the term matrix V (rows: sentences of documents; columns: hashed terms, i.e. pairs of neighbouring ideographs and lower-case words)
is factored as V ~ W H by alternating multiplicative updates for the Kullback-Leibler divergence, with a price on every component that a row of W uses. H has one component per subject,
anchored by the labelled documents and the names of the areas, and one for what is said everywhere; W's rows are drawn towards their document's
mixture, so a sentence without a telling word goes with its document. Components stay tied to their
subjects, so W is read off directly: a sentence deals with its strongest subject unless the common
component explains it; a document has each subject of at least ``MIN_SHARE`` of its sentences that deal with any.

Fit: the anchors and ``ROUNDS`` updates come from a bounded sample of labelled documents (``SAMPLE`` of them with ``SAMPLE_CHARS``
characters together, those with the least hash of the id); one more update of H goes over all documents, its sums added up in the cluster. H is
``TERMS`` x (subjects + 1) numbers, whatever the corpus.

Defined results: null, empty and blank texts have no subject; a document whose sentences are all common has none;
a label of an unknown subject is ignored; repeated labels count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERMS = 1 << 17
SAMPLE = 8_000
SAMPLE_CHARS = 8_000_000
ROUNDS = 6
MIN_SHARE = 0.2
PULL = 1.1
SPARSE = 0.3  # price of a component in a sentence's row
COMMON = 1  # subjects in which a common term may be missing
SAID = 0.1  # expected share of common sentences
SMOOTH = 0.1
ROUND = 300_000  # characters handled at once
_POWERS = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
_DOT = re.compile(r"(?<=[a-z)\"”’%0-9])[.!?](?=\s|$)")


class Terms:
    """Sentences and hashed terms of some texts: doc of each sentence, sentence and term of each occurrence."""

    def __init__(self, texts: list[str]):
        texts = [_DOT.sub("。", t.lower()) if t else "" for t in texts]
        every = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        han = (every >= 0x3400) & (every <= 0x9FFF)
        latin = (every >= 97) & (every <= 122) | (every >= 0xDF) & (every <= 0x24F)
        stop = np.isin(every, np.array([ord(c) for c in "。！？；;\n"], np.uint32))
        piece = np.cumsum(stop) - stop  # number of the piece that a character lies in
        pair = np.flatnonzero(han[:-1] & han[1:])
        a, b = every[pair].astype(np.uint64), every[pair + 1].astype(np.uint64)
        terms = [(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)]
        where = [pair]
        starts = np.flatnonzero(latin & ~np.r_[False, latin[:-1]])
        if starts.size:
            ends = np.flatnonzero(latin & ~np.r_[latin[1:], False]) + 1
            n = np.minimum(ends - starts, 64)
            at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            h = np.add.reduceat(every[at].astype(np.uint64) * _POWERS[offset], np.cumsum(n) - n)
            keep = n > 1
            terms.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48) | np.uint64(TERMS // 2))[keep])
            where.append(starts[keep])
        where, terms = np.concatenate(where), np.concatenate(terms).astype(np.int64)
        order = np.argsort(where, kind="stable")
        where, terms = where[order], terms[order]
        used, self.sentence = np.unique(piece[where], return_inverse=True)  # pieces without a term are none
        self.term = terms
        self.starts = np.flatnonzero(np.r_[True, self.sentence[1:] != self.sentence[:-1]]) if where.size else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        self.doc = np.searchsorted(ends, where[self.starts], side="right")
        self.docs = len(texts)
        self.sentences = len(used)


def weights(h: np.ndarray) -> np.ndarray:
    """Term weights of V: 1 for a term of one component, 0 for one that says nothing on the component."""
    q = h / np.maximum(h.sum(1, keepdims=True), 1e-30)
    return (np.maximum(0, 1 + (q * np.log(np.maximum(q, 1e-12))).sum(1) / np.log(h.shape[1])) ** 2 + 1e-4).astype(np.float32)


def mixtures(t: Terms, h: np.ndarray, prior: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(W, one row per sentence, adding up to 1; the documents' mixtures) by multiplicative updates with H fixed. prior: a row per document or one for all."""
    k = h.shape[1]
    x = h[t.term]
    v = weights(h)[t.term][:, None]
    theta = np.broadcast_to(prior, (t.docs, k)).astype(np.float32)
    n = np.bincount(t.doc, minlength=t.docs)[:, None]
    w = theta[t.doc]
    for _ in range(rounds):
        y = x * w[t.sentence]
        y *= v / y.sum(1, keepdims=True)
        # the document's mixture counts as much as a little over one telling term
        own = np.add.reduceat(y, t.starts, axis=0) + PULL * theta[t.doc]
        own = np.maximum(own - SPARSE, 1e-4 * own)
        w = own / own.sum(1, keepdims=True)
        sums = np.stack([np.bincount(t.doc, w[:, j], t.docs) for j in range(k)], 1)
        theta = ((sums + prior) / (n + 1)).astype(np.float32)
    return w.astype(np.float32), theta


def update(t: Terms, h: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """H o (W' (V / W H)): the sums of this part of the rows."""
    if not len(t.term):
        return np.zeros_like(h, np.float64)
    w, _ = mixtures(t, h, prior)
    y = w[t.sentence]  # a term of a sentence counts for what the sentence deals with
    return np.stack([np.bincount(t.term, y[:, j], TERMS) for j in range(h.shape[1])], 1)


def normal(sums: np.ndarray, smooth: float | None = None) -> np.ndarray:
    """Columns that add up to 1. Every term keeps a little in every component, by its overall frequency, so that few labels aren't taken for the whole truth."""
    half = TERMS // 2
    out = []
    for part in (sums[:half], sums[half:]):  # ideographs and words apart: a subject that is often written about in one language mustn't draw all texts of that language
        whole = part.sum(1, keepdims=True)
        x = part + (SMOOTH if smooth is None else smooth) * (whole / max(whole.sum(), 1e-9) * 100 + 1e-4)
        out.append(x / x.sum(0))
    return np.concatenate(out).astype(np.float32)


def anchors(t: Terms, labels: np.ndarray, names: Terms) -> np.ndarray:
    """The first H: terms of a subject's labelled documents against the rest, terms of its name; the common component holds what every subject has."""
    k = labels.shape[1]
    share = labels / np.maximum(labels.sum(1, keepdims=True), 1)
    by = np.stack([np.bincount(t.term, share[t.doc[t.sentence], j], TERMS) for j in range(k)], 1)
    p = (by + 1e-9) / (by.sum(0) + 1e-6)
    ranked = np.sort(p, 1)
    common = ranked[:, min(COMMON, k - 1)]  # in nearly all subjects at least so frequent
    own = p * (p / np.maximum(p.sum(1, keepdims=True), 1e-12))  # weighted by how much a term is this subject's
    own[names.term, names.doc[names.sentence]] += 1e-3
    return np.concatenate([own / own.sum(0), (common / max(common.sum(), 1e-12))[:, None]], 1)


def fit(texts: list[str], labels: np.ndarray, names: list[str]) -> np.ndarray:
    """H from labelled texts; labels: a row per text, a column per subject."""
    t = Terms(texts)
    k = labels.shape[1]
    h = normal(anchors(t, labels, Terms(names)) * max(1, t.term.size) / (k + 1))
    some = labels.sum(1, keepdims=True)
    prior = np.concatenate([0.9 * labels / np.maximum(some, 1) + 0.1 / k, np.full((len(texts), 1), SAID)], 1)
    prior /= prior.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        h = normal(update(t, h, prior.astype(np.float32)))
    return h


def _prior(k: int) -> np.ndarray:
    return np.r_[np.full(k, (1 - SAID) / k), SAID].astype(np.float32)


def assign(t: Terms, h: np.ndarray, min_share: float = MIN_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, subject, share) of every subject of at least min_share of a document's sentences that deal with any."""
    k = h.shape[1] - 1
    if not len(t.term):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    w, _ = mixtures(t, h, _prior(k), rounds=6)
    best = w.argmax(1)
    counts = np.zeros((t.docs, k + 1))
    np.add.at(counts, (t.doc, best), 1)
    counts = counts[:, :k]
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    doc, subject = np.nonzero((share >= min_share - 1e-9) & (counts > 0))
    return doc, subject, share[doc, subject]


# ------------------------------------------------------------------ in the cluster
def _parts(texts: list[str | None]) -> Iterator[slice]:
    a = size = 0
    for k, x in enumerate(texts):
        size += len(x or "")
        if size >= ROUND:
            yield slice(a, k + 1)
            a, size = k + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, text, subjects of at most ``bound`` labelled documents of at most ``chars`` characters together: those with the least hash of the id."""
    known = labels.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    some = docs.filter(F.trim("text") != "").select("doc_id", "text").join(F.broadcast(known), "doc_id")
    size = some.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at most ``bound`` numbers
    return some.join(F.broadcast(size.withColumn("upto", upto).filter(F.col("upto") <= chars).select("doc_id")), "doc_id")


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, areas: DataFrame) -> tuple[list[str], np.ndarray]:
    """(subjects, H)."""
    named = sorted((r["subject"], f"{r['name_zh'] or ''}\n{r['scope'] or ''}") for r in areas.collect())  # a fixed table of a few rows
    subjects = [s for s, _ in named]
    number = {s: i for i, s in enumerate(subjects)}
    rows = sorted(sample(docs, labels).collect(), key=lambda r: r["doc_id"])
    y = np.zeros((len(rows), len(subjects)))
    for i, r in enumerate(rows):
        for s in r["subjects"]:
            if s in number:
                y[i, number[s]] = 1
    keep = y.sum(1) > 0
    h = fit([r["text"] for r, u in zip(rows, keep, strict=True) if u], y[keep], [n for _, n in named])
    return subjects, whole(spark, docs, h)


def whole(spark: SparkSession, docs: DataFrame, h: np.ndarray) -> np.ndarray:
    """One update of H over all documents: sums per task, added per component in the cluster, (subjects + 1) rows to the driver."""
    shared, k = spark.sparkContext.broadcast(h), h.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, k))
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in _parts(texts):
                total += update(Terms(texts[part]), shared.value, _prior(k - 1))
        used = np.flatnonzero(total.sum(1) > 0).astype(np.int32)
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array([used.tobytes()] * k), pa.array([total[used, j].astype(np.float32).tobytes() for j in range(k)])], names=["component", "terms", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for j, t, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                total.setdefault(j, np.zeros(TERMS))[np.frombuffer(t, np.int32)] += np.frombuffer(s, np.float32)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], names=["component", "sums"])

    parts = docs.filter("text IS NOT NULL").select("text").mapInArrow(sums, "component int, terms binary, sums binary")
    rows = parts.repartition("component").mapInArrow(add, "component int, sums binary").collect()
    total = np.zeros((TERMS, k))
    for r in rows:
        total[:, r["component"]] = np.frombuffer(r["sums"], np.float32)
    return normal(0.5 * total + 0.5 * h * total.sum(0)) if total.sum() else h


def subjects(spark: SparkSession, docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """doc_id, subject, share."""
    names, h = learn(spark, docs, labels, areas)
    shared = spark.sparkContext.broadcast(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for part in _parts(texts):
                doc, s, share = assign(Terms(texts[part]), shared.value)
                yield pa.record_batch([pa.array(ids[part][doc], pa.int64()), pa.array([names[j] for j in s], pa.string()), pa.array(share, pa.float64())], names=["doc_id", "subject", "share"])

    return docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, subject string, share double")
