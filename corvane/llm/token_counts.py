"""Token counts by a two-tier map-side lookup.

Tier 1 is a broadcast table of the lengths of frequent pre-tokens, of at most ``hot_entries`` entries.  The
candidates come from bounded heavy-hitter summaries of every partition (all documents are read; words are
hashed, never shuffled).  Tier 2 is a cache in each Python worker, filled by encoding misses in batches and
emptied when it holds ``cache_entries``.  The tables only save work: a count never depends on them.

Cases: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted row by row; a text that holds
an added-token string, or characters whose class differs between Unicode versions, is encoded whole by the
library; long texts are processed whole; an empty table gives an empty result; words equally frequent enter the table in
order; other columns may have any names, as only the named ones are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.kernel import tidy, word_pieces

#: Characters whose general category is younger than some Unicode tables: texts with them skip the lookup.
UNSURE = "[՘֋֌࢏౜೜₏₝-₟Ꟁ-꯿힤-\U0010ffff]"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, besides ASCII, of texts that the standard library cuts just as well, and faster.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHER = rf"[^\x00-\x1b\x20-\x7e{LATIN}]"
LATIN_PRETOKEN = rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+"
LONGEST_CACHED = 256
SUMMARY_ENTRIES = 4096


def frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Misra-Gries style summary of a partition's words: the heaviest SUMMARY_ENTRIES with their counts."""
    counts: dict[int, int] = {}
    names: dict[int, bytes] = {}
    for batch in batches:
        for _, _, w in word_pieces(batch.column(0), lower=False):
            keys, at, n = np.unique(w.hash, return_index=True, return_counts=True)
            some = n > 1
            for key, i, c in zip(keys[some].tolist(), at[some].tolist(), n[some].tolist(), strict=True):
                if key in counts:
                    counts[key] += c
                elif w.end[i] - w.start[i] <= LONGEST_CACHED:
                    counts[key] = c
                    names[key] = w.data[w.start[i] : w.end[i]].tobytes()
            if len(counts) > 4 * SUMMARY_ENTRIES:
                least = sorted(counts.values(), reverse=True)[2 * SUMMARY_ENTRIES]
                counts = {k: c - least for k, c in counts.items() if c > least}
                names = {k: names[k] for k in counts}
    top = sorted(counts, key=lambda k: -counts[k])[:SUMMARY_ENTRIES]
    yield pa.RecordBatch.from_arrays(
        [pa.array([names[k].decode("utf-8", "ignore") for k in top], pa.string()), pa.array([counts[k] for k in top], pa.int64())],
        names=["word", "n"],
    )


class Counter:
    """Exact counts of one worker: tier 1 and tier 2 share a dict, which falls back to tier 1 when full."""

    def __init__(self, model: str, hot: dict[str, int], cache_entries: int):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        spec = json.loads(model)
        self.hot, self.room = hot, len(hot) + cache_entries
        self.known = dict(hot)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.by_lookup = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        )
        self.split = regex.compile(PRETOKEN).findall
        self.unsure = regex.compile(UNSURE).search
        self.other, self.split_latin = re.compile(OTHER).search, re.compile(LATIN_PRETOKEN).findall

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        latin = [not self.other(t) for t in texts]
        whole = {i for i, t in enumerate(texts) if not self.by_lookup or any(a in t for a in self.added) or not latin[i] and self.unsure(t)}
        parts = [() if i in whole else self.split_latin(t) if latin[i] else self.split(t) for i, t in enumerate(texts)]
        need = set().union(*parts)
        misses = list(need - self.known.keys())
        if len(self.known) + len(misses) > self.room:
            self.known = dict(self.hot)
            misses = list(need - self.known.keys())
        self.known.update(zip(misses, self.lengths(misses), strict=True))
        get = self.known.__getitem__
        out = [sum(map(get, p)) for p in parts]
        for k in misses:
            if len(k) > LONGEST_CACHED:
                del self.known[k]
        for i, n in zip(whole, self.lengths([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out


class PieceCounter:
    """Counts of a sentencepiece model; it has no pre-tokens to look up."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


def _make(blob: bytes, is_json: bool, hot: dict[str, int], cache_entries: int) -> Counter | PieceCounter:
    return Counter(blob.decode(), hot, cache_entries) if is_json else PieceCounter(blob)


def _counting(make: Callable, n_other: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for batch in batches:
            texts = batch.column(n_other)
            counts: list[int] = []
            first, size, rows = 0, 0, texts.to_pylist()
            for i, t in enumerate(rows):
                size += len(t)
                if size > 400_000 or i + 1 == len(rows):
                    counts += counter.count(rows[first : i + 1])
                    first, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_other)), pa.array(counts, pa.int64())], names=[*batch.schema.names[:n_other], "n_tokens"])

    return run


def token_counts(
    docs: DataFrame, tokenizer_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), hot_entries: int = 65_536, cache_entries: int = 400_000
) -> DataFrame:
    """keep columns, n_bytes (UTF-8) and n_tokens of every row.  One narrow pass; the only shuffle is that of
    the partitions' bounded summaries."""
    spark = docs.sparkSession
    is_json = tokenizer_file.endswith(".json")
    blob = Path(tokenizer_file).read_bytes()
    filled = docs.select(*keep, F.octet_length(F.coalesce(docs[text], F.lit(""))).cast("long").alias("n_bytes"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    hot: dict[str, int] = {}
    if is_json:
        summary = filled.select("__text").mapInArrow(tidy(frequent_words), "word string, n long")
        top = summary.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(hot_entries // 2).collect()
        names = [w for r in top for w in (f" {r.word}", r.word)]
        hot = dict(zip(names, Counter(blob.decode(), {}, 0).lengths(names), strict=True))
        hot = {k: v for k, v in hot.items() if len(k) <= LONGEST_CACHED}
    table = spark.sparkContext.broadcast((list(hot), np.fromiter(hot.values(), np.uint16, len(hot)), blob))

    def make() -> Counter | PieceCounter:
        names, lengths, model = table.value
        return _make(model, is_json, dict(zip(names, lengths.tolist(), strict=True)), cache_entries)

    run = _counting(make, len(keep) + 1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filled.schema.fields[:-1])
    return filled.mapInArrow(tidy(run), f"{schema}, n_tokens long")
