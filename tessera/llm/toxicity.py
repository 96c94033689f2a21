"""Toxicity (operator 5): a linear-chain CRF tags toxic words; marginals become document scores and offending offsets.

Labels are by document, so labelled tokens are derived first: over the distinct training texts, words and word beginnings
(3 to 6 bytes) whose documents are toxic far more often than chance allows (a binomial tail, corrected for the number of candidates)
mark their words in toxic texts as toxic.  The CRF learns from these words, their neighbours and stretches of clean
texts, on features of the word and its beginnings.  Forward-backward marginals of every word of a whole text give
its largest and its expected number of toxic words, and a logistic curve fitted on the training texts makes them the score.

Training rows are a bounded sample of labelled rows: the `sample` first by a hash of doc_id, of those with
crc32(doc_id) mod 3 other than 1.  Scores depend on the text alone.

Defined results: a null or empty text has the score of a text without toxic words; without training rows of both labels
all scores are the share of toxic ones (0 if none); a null doc_id isn't held out; repeated rows are scored alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_BYTE, LOWER, Kept, chunks, mix, owner, prefix_hash, runs, span_hash, table
from .crf import Crf

#: Labelled documents that the model is trained on at most.
SAMPLE = 6000
BEGINNINGS = (3, 4, 5, 6)
THRESHOLD = 0.7
#: Words around a marked word, and stretches of a clean text, that the model learns from; words of a chain at most.
AROUND, STRETCH, CUT = 5, 12, 24


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and features (hashes; 0: none) of each word of a chunk."""
    low = LOWER[buf]
    starts, ends = runs(ALNUM_BYTE[buf], offsets)
    sums = prefix_hash(low)
    cols = [span_hash(sums, starts, ends)]
    for k in BEGINNINGS:
        h = mix(span_hash(sums, starts, np.minimum(starts + k, ends)) + np.uint64(k))
        cols.append(np.where(ends - starts >= k, h, np.uint64(0)))
    return owner(offsets, starts), starts, ends, np.stack(cols, axis=1)


class Model:
    """Known features, the CRF over them, and the curve from a document's marginals to its score."""

    def __init__(self, prior: float = 0.0):
        self.known, self.crf, self.curve, self.prior = np.zeros(0, np.uint64), Crf(1, 2), np.zeros(3), prior

    def ids(self, features: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(features.shape, np.int64)
        at = np.minimum(np.searchsorted(self.known, features), len(self.known) - 1)
        return np.where((self.known[at] == features) & (features != 0), at + 1, 0)

    def toxic(self, doc: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Of each word, the marginal probability of being toxic."""
        if not len(doc) or not len(self.known):
            return np.zeros(len(doc))
        _, first, back = np.unique(features[:, 0], return_index=True, return_inverse=True)
        e = self.crf.emissions(self.ids(features[first]))[back.reshape(-1)]
        return self.crf.marginals(e, np.r_[True, doc[1:] != doc[:-1]])[:, 1]

    def evidence(self, n: int, doc: np.ndarray, p: np.ndarray) -> np.ndarray:
        most = np.zeros(n)
        np.maximum.at(most, doc, p)
        return np.stack([np.ones(n), np.log((most + 1e-4) / (1 - most + 1e-4)), np.log1p(np.bincount(doc, np.where(p > 0.05, p, 0), n))], axis=1)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(evidence), self.prior)
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve, -30, 30)))


def counted(texts: pa.Array, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, texts that hold it, toxic ones among them); a text lies in one chunk, so counts add up."""
    parts = []
    for i, _, buf, offsets in chunks(texts):
        doc, _, _, features = words(buf, offsets)
        flat, text = features.reshape(-1), np.repeat(doc, features.shape[1])
        first = np.unique(mix(flat ^ mix(text.astype(np.uint64))), return_index=True)[1]
        known, back = np.unique(flat[first], return_inverse=True)
        parts.append((known, np.bincount(back, minlength=len(known)), np.bincount(back, label[text[first] + i], len(known))))
    feature, every, toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
    known, back = np.unique(feature, return_inverse=True)
    return known, np.bincount(back, every, len(known)), np.bincount(back, toxic, len(known))


def lexicon(known: np.ndarray, every: np.ndarray, toxic: np.ndarray, label: np.ndarray, level: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(features in 3 texts or more, marked ones): those whose texts are toxic more often than chance allows."""
    rate, share = np.clip(label.mean(), 1e-6, 1 - 1e-6), np.clip(toxic / every, 1e-9, 1 - 1e-9)
    tail = every * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    marked = (share > 0.8) & (tail > np.log(max(len(known), 2) / level)) & (known != 0)
    return known[(every >= 3) & (known != 0)], known[marked]


def _chains(model: Model, marked: np.ndarray, texts: pa.Array, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Marked words of toxic texts with their neighbours, and a stretch of each clean text."""
    rng = np.random.default_rng(3)
    for i, _, buf, offsets in chunks(texts):
        doc, _, _, features = words(buf, offsets)
        tags = (np.isin(features, marked).any(axis=1) & (label[doc + i] == 1)).astype(np.int64)
        ids = model.ids(features)
        head = np.r_[0, np.flatnonzero(np.diff(doc)) + 1, len(doc)] if len(doc) else np.zeros(1, int)
        for a, b in zip(head[:-1].tolist(), head[1:].tolist(), strict=True):
            if tags[a:b].any():
                near = np.convolve(tags[a:b], np.ones(2 * AROUND + 1, int), "same")[: b - a] > 0 if b - a > 2 * AROUND else np.ones(b - a, bool)
                cut = np.flatnonzero(np.diff(np.r_[False, near, False]))
                spans = [(a + x, a + y) for x, y in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True)]
            elif label[doc[a] + i] == 0:
                x = a + int(rng.integers(0, max(1, b - a - STRETCH)))
                spans = [(x, min(x + STRETCH, b))]
            else:
                spans = []
            for x, y in spans:
                for k in range(x, y, CUT):
                    yield ids[k : min(k + CUT, y)].copy(), tags[k : min(k + CUT, y)].copy()


def fitted(texts: pa.Array, label: np.ndarray) -> Model:
    """The model of labelled texts, in three passes over them that hold a chunk at a time."""
    if len(label) == 0 or label.min() == label.max():
        return Model(float(label.mean()) if len(label) else 0.0)
    model = Model()
    model.known, marked = lexicon(*counted(texts, label), label)
    model.crf = Crf(len(model.known) + 1, 2).train(list(_chains(model, marked, texts, label)), rounds=40, rate=0.3)
    x = []
    for i, j, buf, offsets in chunks(texts):
        doc, _, _, features = words(buf, offsets)
        x.append(model.evidence(j - i, doc, model.toxic(doc, features)))
    x, y = np.concatenate(x), label.astype(float)
    for _ in range(25):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        model.curve += np.linalg.solve(h, x.T @ (y - p) - 0.05 * model.curve)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows that aren't held out."""
    rows = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` ids, so a broadcast of known size; copies of a text count once
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("toxic").alias("toxic")).orderBy("h").limit(sample).select("text", "toxic")
    got = found.toArrow()
    return fitted(got["text"].combine_chunks() if got["text"].num_chunks else pa.array([], pa.string()), got["toxic"].to_numpy().astype(np.int64))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, spans = [], []
            for i, j, buf, offsets in chunks(batch.column(0)):
                doc, starts, ends, features = words(buf, offsets)
                p = model.toxic(doc, features)
                scores.append(model.scores(model.evidence(j - i, doc, p)))
                own: list[list] = [[] for _ in range(j - i)]
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
                    for k, d in zip(hit.tolist(), doc[hit].tolist(), strict=True):
                        zero = int(points[offsets[d]])
                        own[d].append({"start": int(points[starts[k]]) - zero, "end": int(points[ends[k]]) - zero, "probability": float(p[k])})
                spans += own
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, kind)], [*batch.schema.names[1:], "score", "toxic_spans"])

    return run


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' columns `keep` with score and toxic_spans (start, end in code points, probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = Kept(docs, keep, ("score", "toxic_spans"))
    out = docs.select("text", *kept.columns).mapInArrow(_scored(shared), f"{kept.kinds}score double, toxic_spans array<struct<start: long, end: long, probability: double>>")
    return out.select(*kept.back, "score", "toxic_spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("toxic_spans").cast("long").alias("n_toxic_words"))


QUERIES = {"op5_toxicity": op5_toxicity}
