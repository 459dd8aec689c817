"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters (lower-cased where that is one character) give n-grams of 1 to 3, hashed to BUCKETS.  Document
frequencies are counted over all learning documents.  Weights are trained by follow-the-regularised-leader
(FTRL-proximal) with elastic-net penalties on a bounded sample; a temperature fitted on rows of the sample kept
aside calibrates the probabilities.  Texts are read whole.

The sample has at most ``max_fit_rows`` rows, one for each distinct text of a language.  The languages take turns
with their texts of least hash, so copies cannot crowd it out and a rare language is in it at any size.  The temperature is
fitted on a fifth of each language's rows, and on none of a language with fewer than five.

Cases: ``und`` with score 0 for a null text or one without a letter; rows of null language teach nothing; a
single learnt language is predicted with score 1; without any, and in an empty table, all is ``und``; ties go to the
language that sorts first; repeated rows count in the document frequencies and once in the sample; a text given in
two languages is learnt in both; other columns may have any names, as only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.kernel import pieces, tidy, utf8

BITS = 13
BUCKETS = 1 << BITS
UND = "und"
#: Documents of a piece: its dense counts take this many times BUCKETS numbers.
PIECE_ROWS = 128
_luts: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _luts:
        lower = np.arange(0x110000, dtype=np.uint32)
        letter = np.zeros(0x110000, bool)
        for c in range(0x30000):
            s = chr(c)
            letter[c] = s.isalpha()
            if len(x := s.lower()) == 1:
                lower[c] = ord(x)
        letter[0x30000:0x32400] = [chr(c).isalpha() for c in range(0x30000, 0x32400)]
        _luts.update(lower=lower, letter=letter)
    return _luts["lower"], _luts["letter"]


def counts_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (documents x BUCKETS) of hashed character n-grams; whether a document has a letter."""
    lower, letter = _tables()
    n = len(offsets) - 1
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = lead[offsets] if len(chars) == lead[-1] else np.minimum(lead[offsets], len(chars))
    doc = np.repeat(np.arange(n), np.diff(at))
    c = lower[chars]
    has = np.bincount(doc, weights=letter[chars], minlength=n) > 0
    total = np.zeros(n * BUCKETS, np.int32)
    h = np.zeros(len(c), np.uint32)
    for k, odd in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
        m = len(c) - k
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + c[k:] * np.uint32(odd)
        key = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        key = (key >> np.uint32(32 - BITS)).astype(np.int64) + doc[:m] * BUCKETS
        total += np.bincount(key[doc[:m] == doc[k:]], minlength=n * BUCKETS).astype(np.int32)
    return total.reshape(n, BUCKETS), has


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax((tfidf(counts, self.idf) @ self.weight + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, seed: int = 5) -> np.ndarray:
    """FTRL-proximal, per coordinate, with elastic net; the last row of the weights is the bias."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    rng = np.random.default_rng(seed)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[at] = old + g * g
    return weights(z, n)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for a, b in pieces(offsets, rows=PIECE_ROWS):
            counts, _ = counts_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            df += (counts > 0).sum(0)
        n += batch.num_rows
    if n:
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n), pa.int64())], names=["bucket", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of the chosen texts, each (language, hash) once a task: at most the sample's size."""
    seen = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
        new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        if not new:
            continue
        batch = batch.take(pa.array(new))
        data, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets, rows=PIECE_ROWS):
            counts, _ = counts_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out = []
            for r in counts:
                at = np.flatnonzero(r)
                out.append(np.stack((at.astype(np.int32), r[at].astype(np.int32))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.binary()), batch.column(2).slice(a, b - a)], names=["lang", "x", "h"])


def fit(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text", max_fit_rows: int = 4_096) -> Model | None:
    """Model of the rows where learn holds and text and language are given."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    df = rows.select("text").mapInArrow(tidy(_frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS + 1 rows
    if not df:
        return None
    seen = np.zeros(BUCKETS + 1, np.int64)
    for r in df:
        seen[r.bucket] = r.n
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)
    keyed = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = keyed.select("lang", "h").distinct().withColumn("turn", turn).filter(F.col("turn") <= max_fit_rows).orderBy("turn", "lang").limit(max_fit_rows)
    known = docs.sparkSession.createDataFrame(chosen.select("lang", "h").collect(), "lang string, h long")  # at most max_fit_rows rows, so it may be broadcast
    sample = keyed.join(F.broadcast(known), ["lang", "h"]).select("lang", "text", "h").mapInArrow(tidy(_sparse), "lang string, x binary, h long")
    got = sample.groupBy("lang", "h").agg(F.min("x").alias("x")).collect()  # at most max_fit_rows rows
    got = sorted(got, key=lambda r: (r.lang, bytes(r.x)))
    languages = sorted({r.lang for r in got})
    y = np.array([languages.index(r.lang) for r in got])
    sparse = []
    for r in got:
        at, c = np.frombuffer(r.x, np.int32).reshape(2, -1)
        x = np.log1p(c.astype(np.float32)) * idf[at]
        sparse.append((at, x / max(np.sqrt((x * x).sum()), 1e-9)))
    if len(languages) < 2:
        return Model(languages, idf, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)), 1.0) if languages else None
    aside = set_aside(y)
    w = ftrl([s for s, k in zip(sparse, aside, strict=True) if not k], y[~aside], len(languages))
    logits = np.array([x @ w[at] + w[BUCKETS] for (at, x), k in zip(sparse, aside, strict=True) if k]).reshape(-1, len(languages))
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 60) if len(logits) else ():
        loss = -np.log(np.maximum(softmax(logits / t)[np.arange(len(logits)), y[aside]], 1e-12)).mean()
        if loss < best:
            best, temperature = loss, float(t)
    return Model(languages, idf, w[:BUCKETS].astype(np.float32), w[BUCKETS], temperature)


def set_aside(y: np.ndarray, seed: int = 3) -> np.ndarray:
    """A fifth of each language's rows, rounded down: of fewer than five none, so that every language is learnt."""
    out, rng = np.zeros(len(y), bool), np.random.default_rng(seed)
    for k in np.unique(y):
        own = np.flatnonzero(y == k)
        out[rng.permutation(own)[: len(own) // 5]] = True
    return out


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, lang_pred and score of every row, in one narrow pass."""
    rows = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("__text"))
    if model is None:
        return rows.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(len(names)))
            said, score = [], np.zeros(batch.num_rows)
            for a, b in pieces(offsets, rows=PIECE_ROWS):
                counts, has = counts_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                p = m.probabilities(counts)
                top = p.argmax(1)
                said += [m.languages[k] if h else UND for k, h in zip(top, has, strict=True)]
                score[a:b] = np.where(has, p.max(1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(said, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")
