"""Quality scores by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled good, one labelled bad) give a logistic loss on the difference of
their features; its minimiser is a linear score.  The cut is a quantile of the scores of the learning rows:
the share of bad labels among them.  The score is then moved and stretched so that the cut is at 0.3.

Only the fit uses a bounded sample: at most ``max_fit_rows`` labelled ids, those of least hash, with one row each.
Every text is scored whole.  Labels, language, source and id are no inputs of a score.

Cases: a null text is scored as an empty one; empty texts get the score of all-zero counts; rows without a
label are scored but not learnt from; labels other than 0 and 1, and null ids, teach nothing; with several
labels for an id the least counts; of several rows of an id the one of least features teaches; equal texts get equal
scores; a score at the cut is kept; without both labels among the learning rows every score is 0.5; an empty table
gives an empty result; other columns may have any names, as only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.kernel import BLANK, Words, pieces, tidy, utf8

BUCKETS = 512
CUT = 0.3
_KIND = np.full(256, 0, np.int64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord(c) for c in "#*$%&|<>"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in ".,;:"]] = 6
_KIND[128:] = 7
_KIND[BLANK] = 8
_KIND[ord("\n")] = 9
KINDS = 10
DENSE = KINDS + 6
WIDTH = DENSE + BUCKETS
PIECE_ROWS = 1024


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of features: byte classes, lengths, repetition of words and word triples, hashed byte pairs."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    with np.errstate(over="ignore"):
        w = Words(data, offsets, lower=False)
        out = np.zeros((n, WIDTH), np.float32)
        share = np.maximum(size, 1)[:, None]
        out[:, :KINDS] = np.bincount(doc * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS) / share
        words = np.maximum(w.count, 1)
        distinct = np.zeros(n)
        if len(w.hash):
            order = np.lexsort((w.hash, w.doc))
            h, d = w.hash[order], w.doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            distinct = np.bincount(d[new], minlength=n)
        triples = np.bincount(w.shingles(3)[0], minlength=n)
        out[:, KINDS] = np.log1p(w.count)
        out[:, KINDS + 1] = np.minimum(size / words, 60)
        out[:, KINDS + 2] = distinct / words
        out[:, KINDS + 3] = triples / np.maximum(w.count - 2, 1)
        out[:, KINDS + 4] = np.log1p(size)
        out[:, KINDS + 5] = np.sqrt(out[:, 9])
        if len(data) > 1:
            low = data.astype(np.uint32)
            pair = ((low[:-1] * np.uint32(0x9E3779B1)) ^ (low[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
            pair = (pair >> np.uint32(23)).astype(np.int64)
            same = doc[1:] == doc[:-1]
            out[:, DENSE:] = np.sqrt(np.bincount(doc[1:][same] * BUCKETS + pair[same], minlength=n * BUCKETS).reshape(n, BUCKETS) / share)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 0, 1)


def fit_bradley_terry(x: np.ndarray, good: np.ndarray, pairs: int = 32_768, epochs: int = 60, l2: float = 1e-3, seed: int = 11) -> Model | None:
    """Logistic loss on feature differences of preference pairs, by full-batch momentum descent."""
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float32)
    rng = np.random.default_rng(seed)
    left, right = rng.choice(a, pairs), rng.choice(b, pairs)
    weight = np.zeros(x.shape[1], np.float32)
    speed, m2 = np.zeros_like(weight), np.zeros_like(weight)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(pairs)
        for part in np.array_split(order, max(1, pairs // 2048)):
            d = z[left[part]] - z[right[part]]
            p = 1 / (1 + np.exp(np.clip(d @ weight, -30, 30)))
            g = -(d.T @ p) / len(part) + l2 * weight
            step += 1
            speed = 0.9 * speed + 0.1 * g
            m2 = 0.99 * m2 + 0.01 * g * g
            weight -= 0.02 * (speed / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    model = Model(mean.astype(np.float32), scale.astype(np.float32), weight, 0.0, 1.0)
    raw = model.raw(x)
    # the cut: the quantile at the share of bad labels, between the scores on its two sides
    ordered, k = np.sort(raw), len(b)
    model.cut = float((ordered[k - 1] + ordered[min(k, len(ordered) - 1)]) / 2)
    best, base = np.inf, np.log(CUT / (1 - CUT))
    for slope in np.geomspace(0.02, 5, 40):
        zz = np.clip(slope * (raw - model.cut) + base, -30, 30)
        loss = np.mean(np.logaddexp(0, np.where(good, -zz, zz)))
        if loss < best:
            best, model.slope = loss, float(slope)
    return model


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least features of each place of the sample among a task's rows: at most the sample's size."""
    least: dict[int, bytes] = {}
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        place = batch.column(0).to_pylist()
        for a, b in pieces(offsets, rows=PIECE_ROWS):
            for p, r in zip(place[a:b], features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), strict=True):
                x = r.tobytes()
                if p not in least or x < least[p]:
                    least[p] = x
    yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.binary())], names=["place", "x"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text", max_fit_rows: int = 8_192) -> Model | None:
    """Model of the labelled learning rows: one row of each of at most max_fit_rows ids, those that hash least."""
    ids = (
        labels.filter(learn & F.col(id_column).isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(id_column)
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64(id_column), id_column)
        .limit(max_fit_rows)
        .collect()
    )
    schema = f"`{id_column}` {labels.schema[id_column].dataType.simpleString()}, __place int"
    known = docs.sparkSession.createDataFrame([(r[0], n) for n, r in enumerate(ids)], schema)  # at most max_fit_rows rows, so it may be broadcast
    rows = docs.select(id_column, F.coalesce(docs[text], F.lit("")).alias("__text")).join(F.broadcast(known), id_column).select("__place", "__text")
    # of an id's rows the one of least features, in each task and then among the tasks: the order of arrival does not matter
    got = rows.mapInArrow(tidy(_features_of), "place int, x binary").groupBy("place").agg(F.min("x").alias("x")).orderBy("place").collect()  # at most max_fit_rows rows
    if not got:
        return None
    got.sort(key=lambda r: (bytes(r.x), ids[r.place].quality))
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(len(got), WIDTH)
    return fit_bradley_terry(x, np.array([ids[r.place].quality == 1 for r in got]))


def quality_scores(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns and score (0 to 1; CUT is the rejecting quantile) of every row, in one narrow pass."""
    rows = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("__text"))
    if model is None:
        return rows.select(*keep, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(len(names)))
            score = np.zeros(batch.num_rows)
            for a, b in pieces(offsets, rows=PIECE_ROWS):
                score[a:b] = m.score(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(score, pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(run), f"{schema}, score double")


def good_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows, all columns, that the model does not reject."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[text].alias(text))
    return quality_scores(rows, model, ("__row",), text).filter(F.col("score") >= CUT).select("__row.*")
