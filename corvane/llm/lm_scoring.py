"""Scores of an interpolated modified Kneser-Ney bigram model, counted over all learning documents.

Three passes over the texts, each a scan without a shuffle of words:

1. words are counted per task and merged by hash range: the vocabulary, sorted arrays of 64-bit hashes, in
   which a word's place is its number;
2. bigrams of numbers are counted per task, packed (sorted, delta-coded, compressed), merged by bucket into
   sorted arrays of keys and counts; numbers of followers (by count 1, 2, 3+) and of predecessors of each word
   come from the merged arrays;
3. texts are scored by workers that memory-map the arrays.

Arrays are files in the shared folder, written under a temporary name and renamed, so a repeated task does no
harm; on a store that cannot be mapped, the workers of an executor share a copy that goes with it.  Buckets hold about
BUCKET_KEYS keys whatever the input's size, so no task holds the model; mapped pages, not memory, bound it.

Tokens are words, A-Z lower-cased, then one end mark; a text's first token follows a start mark.  Cases: a
null text is empty, just the end mark; unknown words take the uniform share of the lowest order; without
learning documents all counts are 0 and the model is uniform; an empty table gives an empty result; repeated rows count
as often as they occur; long texts are read whole; other columns may have any names, as only the named ones are read.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import scratch_path
from corvane.llm.kernel import U, Words, mix, pieces, tidy, utf8

END = U(0xE2D0E2D0E2D0E2D1)
#: The vocabulary is cut by leading bits of the hash, into 2**6 parts or more for more input partitions.
LEAST_BITS, MOST_BITS = 6, 12
IDS_PER_PART = 1 << 20
BUCKET_KEYS = 4_000_000
FLUSH_KEYS = 6_000_000
PIECE = 4 << 20


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts as compressed bytes."""
    delta = np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.copy()
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype(np.uint64)
    body = np.array([len(keys), len(large)], np.uint64).tobytes() + delta.tobytes() + small.tobytes() + large.tobytes()
    return np.uint64(len(body)).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob, np.uint64, 1)[0]), codec="zstd", asbytes=True)
    n, m = map(int, np.frombuffer(body, np.uint64, 2))
    delta = np.frombuffer(body, np.uint8, 8 * n, 16).reshape(8, n).T.copy().view(np.uint64)[:, 0]
    counts = np.frombuffer(body, np.uint8, n, 16 + 8 * n).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(body, np.uint64, m, 16 + 9 * n)
    return np.cumsum(delta, dtype=np.uint64), counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their summed counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.unique(keys, return_counts=True)
    return k, n.astype(np.uint64)


def put(folder: str, name: str, array: np.ndarray) -> None:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as f:
        f.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")
    store.move(temporary, f"{path}/{name}")


class Files:
    """Memory-mapped arrays of a folder.

    On a store that cannot be mapped a node's workers share one copy of the files they need, in the executor's local
    folder, which goes with the executor."""

    def __init__(self, folder: str):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.local = isinstance(self.store, fs.LocalFileSystem)
        base = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or tempfile.gettempdir()
        self.copy = os.path.join(base, "corvane-lm-" + hashlib.sha256(folder.encode()).hexdigest()[:16])
        self.open: dict[str, np.ndarray] = {}

    def get(self, name: str, kind: type) -> np.ndarray:
        if name not in self.open:
            path = f"{self.path}/{name}"
            if not self.local:
                path = self._copied(path, name)
            self.open[name] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        return self.open[name]

    def _copied(self, path: str, name: str) -> str:
        held = os.path.join(self.copy, name)
        if not os.path.exists(held):
            os.makedirs(self.copy, exist_ok=True)
            fresh = f"{held}.{uuid.uuid4().hex}"
            with self.store.open_input_stream(path) as a, open(fresh, "wb") as b:
                shutil.copyfileobj(a, b)
            os.replace(fresh, held)  # whoever comes second replaces equal bytes
        return held


class Vocabulary:
    """Numbers of words: places in the sorted hashes.  unknown is the number of every other word, start follows."""

    def __init__(self, files: Files, sizes: list[int]):
        self.files, self.parts = files, len(sizes)
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.uint64)
        self.unknown = int(self.first[-1])
        self.start = self.unknown + 1

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of sorted distinct hashes."""
        out, count = np.full(len(hashes), self.unknown, np.uint64), np.zeros(len(hashes), np.uint64)
        cut = np.searchsorted(hashes, np.arange(1, self.parts, dtype=np.uint64) << U(64 - self.parts.bit_length() + 1))
        for b, (s, e) in enumerate(zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(hashes)])), strict=True)):
            if s == e or self.first[b] == self.first[b + 1]:
                continue
            keys = self.files.get(f"words-{b}", np.uint64)
            at = np.minimum(np.searchsorted(keys, hashes[s:e]), len(keys) - 1)
            hit = keys[at] == hashes[s:e]
            out[s:e][hit] = self.first[b] + at[hit].astype(np.uint64)
            count[s:e][hit] = self.files.get(f"counts-{b}", np.uint64)[at[hit]]
        return out, count


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a piece, each document's followed by END; places of the END marks."""
    ends = np.cumsum(w.count + 1) - 1
    out = np.full(len(w.hash) + w.n_docs, END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = w.hash
    return out, ends


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    data, offsets = utf8(batch.column(column))
    for a, b in pieces(offsets, PIECE):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _blobs(parts: list[tuple[np.ndarray, np.ndarray]], bucket: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys, counts = merged(parts)
    b = bucket(keys)
    order = np.argsort(b, kind="stable")
    b, keys, counts = b[order], keys[order], counts[order]
    at = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)])) if len(b) else np.zeros(1, int)
    for s, e in zip(at[:-1], at[1:], strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([int(b[s])], pa.int64()), pa.array([pack(keys[s:e], counts[s:e])], pa.binary())], names=["bucket", "blob"])


def _collect(keys_of: Callable[[Words], np.ndarray], bucket: Callable[[np.ndarray], np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, _, w in _pieces(batch, 0):
                parts.append(_count(keys_of(w)))
                held += len(parts[-1][0])
                if held > FLUSH_KEYS:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > FLUSH_KEYS // 2:
                        yield from _blobs(parts, bucket)
                        parts, held = [], 0
        yield from _blobs(parts, bucket)

    return run


def _vocabulary_part(folder: str) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        keys, counts = merged([unpack(x.as_py()) for x in t.column("blob")])
        put(folder, f"words-{b}", keys)
        put(folder, f"counts-{b}", counts)
        return pa.table({"bucket": [b], "n": [len(keys)], "total": [int(counts.sum())]})

    return run


def _bigram_bucket(n: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda keys: (mix((keys >> U(32)) * U(0x9E3779B97F4A7C15) + ((keys & U(0xFFFFFFFF)) >> U(20))) % U(n)).astype(np.int64)


def _bigrams_of(v: Vocabulary) -> Callable[[Words], np.ndarray]:
    def run(w: Words) -> np.ndarray:
        tokens, ends = _tokens(w)
        words, inverse = np.unique(tokens, return_inverse=True)
        number = v.numbers(words)[0][inverse]
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[np.concatenate(([0], ends[:-1] + 1))] = v.start
        return (before << U(32)) | number

    return run


def _bigram_part(folder: str) -> Callable[[pa.Table], pa.Table]:
    """Writes a bucket's keys and counts; gives followers (u) and predecessors (w) by range of numbers, and the counts of counts."""

    def run(t: pa.Table) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        keys, counts = merged([unpack(x.as_py()) for x in t.column("blob")])
        put(folder, f"bigrams-{b}", keys)
        put(folder, f"times-{b}", np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))
        part, blob = [-1], [np.array([(counts == c).sum() for c in (1, 2, 3, 4)], np.uint64).tobytes()]
        code = np.minimum(counts, 3) - U(1)  # 0, 1, 2 for followers; 3 for predecessors
        followers = _count(((keys >> U(32)) << U(2)) | code)
        predecessors = _count(((keys & U(0xFFFFFFFF)) << U(2)) | U(3))
        for k, n in (followers, predecessors):
            where = (k >> U(2)) // U(IDS_PER_PART)
            at = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(k)]))
            for s, e in zip(at[:-1], at[1:], strict=True):
                part.append(int(where[s]))
                blob.append(pack(k[s:e], n[s:e]))
        return pa.table({"bucket": pa.array(part, pa.int64()), "blob": pa.array(blob, pa.binary())})

    return run


def _statistics_part(folder: str) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        if b < 0:
            out = sum(np.frombuffer(x.as_py(), np.uint64) for x in t.column("blob"))
        else:
            keys, counts = merged([unpack(x.as_py()) for x in t.column("blob")])
            dense = np.zeros((4, IDS_PER_PART), np.uint32)
            dense[(keys & U(3)).astype(int), ((keys >> U(2)) % U(IDS_PER_PART)).astype(int)] = counts
            put(folder, f"types-{b}", dense)
            p = dense[3]
            out = np.array([*((p == c).sum() for c in (1, 2, 3, 4)), (p >= 3).sum(), p.sum(dtype=np.uint64)], np.uint64)
        return pa.table({"bucket": pa.array([b], pa.int64()), "blob": pa.array([out.tobytes()], pa.binary())})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3+, from counts of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [0.0]
    for k in (1, 2, 3):
        least = (0.5, 0.75, 1.0)[k - 1]
        x = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] and n[0] else least
        d.append(min(max(x, 0.05), k - 0.05))
    return np.array(d)


class Scorer:
    """One worker's view of the model."""

    def __init__(self, folder: str, spec: dict):
        self.files = Files(folder)
        self.v = Vocabulary(self.files, spec["sizes"])
        self.spec, self.bucket = spec, _bigram_bucket(spec["buckets"])

    def types(self, numbers: np.ndarray, rows: slice | int) -> np.ndarray:
        out = np.zeros((4, len(numbers)))
        part = (numbers // U(IDS_PER_PART)).astype(int)
        for b in np.unique(part):
            if b in self.spec["parts"]:
                here = part == b
                dense = self.files.get(f"types-{b}", np.uint32).reshape(4, IDS_PER_PART)
                out[:, here] = dense[:, (numbers[here] % U(IDS_PER_PART)).astype(int)]
        return out[rows]

    def score(self, w: Words) -> tuple[np.ndarray, ...]:
        s, v = self.spec, self.v
        tokens, ends = _tokens(w)
        words, inverse = np.unique(tokens, return_inverse=True)
        number, count = v.numbers(words)
        # lowest order: predecessors, discounted, over all bigram types; the rest is uniform
        pred = self.types(number, 3)
        d1 = np.array(s["d1"])
        types = max(s["types"], 1)
        low = np.maximum(pred - d1[np.minimum(pred, 3).astype(int)], 0) / types + (s["free1"] / types if s["types"] else 1.0) / (s["vocabulary"] + 1)
        start = np.concatenate(([0], ends[:-1] + 1))
        ids = number[inverse]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[start] = v.start
        keys, back = np.unique((before << U(32)) | ids, return_inverse=True)
        times = np.zeros(len(keys))
        if s["types"]:
            b = self.bucket(keys)
            order = np.argsort(b, kind="stable")
            at = np.concatenate(([0], np.flatnonzero(np.diff(b[order])) + 1, [len(b)]))
            for x, y in zip(at[:-1], at[1:], strict=True):
                here = order[x:y]
                name = int(b[here[0]])
                if name not in s["filled"]:
                    continue
                held = self.files.get(f"bigrams-{name}", np.uint64)
                p = np.minimum(np.searchsorted(held, keys[here]), len(held) - 1)
                hit = held[p] == keys[here]
                times[here[hit]] = self.files.get(f"times-{name}", np.uint32)[p[hit]]
        d2 = np.array(s["d2"])
        u_id = keys >> U(32)
        u, u_back = np.unique(u_id, return_inverse=True)
        n1, n2, n3 = self.types(u, slice(0, 3))
        total = np.where(u == U(v.start), s["train_docs"], 0).astype(float)
        total[u < U(v.unknown)] = self.counts(u[u < U(v.unknown)])
        seen = np.maximum(total, 1)
        gamma = np.where(total > 0, (d2[1] * n1 + d2[2] * n2 + d2[3] * n3) / seen, 1.0)
        by_number = np.argsort(number, kind="stable")
        place = np.searchsorted(number[by_number], keys & U(0xFFFFFFFF))
        low_sorted = low[by_number]
        p = np.maximum(times - d2[np.minimum(times, 3).astype(int)], 0) / seen[u_back] + gamma[u_back] * low_sorted[place]
        doc_sum = lambda x: np.add.reduceat(x, start)
        known = count > 0
        base = np.log10((count + 1.0) / (s["tokens"] + s["vocabulary"] + 1.0))
        n = np.diff(np.concatenate((start, [len(tokens)])))
        return n, doc_sum(known[inverse].astype(np.int64)), doc_sum(base[inverse]), doc_sum(np.log10(p)[back])

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers))
        part = np.searchsorted(self.v.first, numbers, "right") - 1
        for b in np.unique(part):
            here = part == b
            out[here] = self.files.get(f"counts-{b}", np.uint64)[(numbers[here] - self.v.first[b]).astype(int)]
        return out


def train(docs: DataFrame, learn: Column, text: str = "text") -> tuple[str, dict]:
    """Count the model over the rows where learn holds: (folder of its arrays, its numbers)."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "lm")
    texts = docs.filter(learn).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    blob = "bucket long, blob binary"
    bits = min(MOST_BITS, max(LEAST_BITS, (texts.rdd.getNumPartitions() // 8).bit_length()))
    by_range = texts.mapInArrow(tidy(_collect(lambda w: _tokens(w)[0], lambda k: (k >> U(64 - bits)).astype(np.int64))), blob)
    parts = by_range.groupBy("bucket").applyInArrow(_vocabulary_part(folder), "bucket long, n long, total long").collect()  # at most 2**bits rows
    sizes = [0] * (1 << bits)
    for r in parts:
        sizes[r.bucket] = r.n
    tokens, vocabulary = sum(r.total for r in parts), sum(sizes)
    if vocabulary + 2 >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    spec = {"sizes": sizes, "tokens": tokens, "vocabulary": vocabulary, "buckets": max(1, -(-tokens // BUCKET_KEYS)), "train_docs": texts.count()}
    n = spec["buckets"]

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _collect(_bigrams_of(Vocabulary(Files(folder), sizes)), _bigram_bucket(n))(batches)

    types = texts.mapInArrow(tidy(bigrams), blob).groupBy("bucket").applyInArrow(_bigram_part(folder), blob)
    rows = types.groupBy("bucket").applyInArrow(_statistics_part(folder), blob).collect()  # a row for each 2**20 words
    got = {r.bucket: [int(x) for x in np.frombuffer(r.blob, np.uint64)] for r in rows}
    of_counts = got.pop(-1, [0, 0, 0, 0])
    low = [sum(x[i] for x in got.values()) for i in range(6)]
    d1, d2 = discounts(low[:4]), discounts(of_counts)
    store, path = fs.FileSystem.from_uri(folder)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True))]
    filled = {int(x.split("-")[1]) for x in names if x.startswith("bigrams-")}
    spec |= {"d1": d1.tolist(), "d2": d2.tolist(), "types": low[5], "free1": float(d1[1] * low[0] + d1[2] * low[1] + d1[3] * low[4]), "parts": set(got), "filled": filled}
    return folder, spec


def lm_scores(docs: DataFrame, model: tuple[str, dict], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    folder, spec = model
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("__text"))
    names = [f.name for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(folder, shared.value)
        for batch in batches:
            for a, b, w in _pieces(batch, len(names)):
                n, known, base, score = scorer.score(w)
                given = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                total = np.full(b - a, scorer.spec["tokens"], np.int64)
                yield pa.RecordBatch.from_arrays([*given, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(total), pa.array(base), pa.array(score)], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(run), f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
