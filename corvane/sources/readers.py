"""Sources: document folders, JSON lines, gold sets, vocabularies, caches.

Files are read by Spark's own readers; bad input becomes rows of an error table, never an exception.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X

SUFFIXES = ("pdf", "md", "txt")
STORE_SUFFIXES = (*SUFFIXES, "docx")
DOCUMENT = "path string, name string, extension string, text string, error string"


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of PDF and DOCX files."""
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            name = path.rsplit("/", 1)[-1]
            kind = name.rsplit(".", 1)[-1].lower()
            text, error = "", None
            try:
                if kind == "pdf":
                    import io

                    import pypdf  # optional

                    pages = pypdf.PdfReader(io.BytesIO(content)).pages
                    text = "\n\n".join(f"[Page {i}]\n{p.extract_text()}" for i, p in enumerate(pages, 1))
                else:
                    import io
                    import re
                    import zipfile

                    xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8", "replace")
                    text = re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", xml))
            except Exception as e:  # a file that cannot be read is a row of the error table
                error = f"{type(e).__name__}: {e}"
            rows.append((path, name, kind, text, error))
        yield pd.DataFrame(rows, columns=["path", "name", "extension", "text", "error"])


def documents(spark: SparkSession, folder: str, suffixes: Sequence[str] = SUFFIXES, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a folder and its subfolders, dot-paths left out; empty texts are errors, bytes that are no UTF-8 are replaced.

    Plain text stays in the JVM; rows come in no order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(folder)
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    wanted = files.filter(kind.isin(*suffixes) & ~F.col("path").rlike(r"/\.[^/]")).withColumn("extension", kind)
    packed = F.col("extension").isin("pdf", "docx")
    plain = wanted.filter(~packed).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "extension", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("error"))
    read = plain.unionByName(wanted.filter(packed).select("path", "content").mapInPandas(_unpacked, DOCUMENT))
    body = F.trim(F.left("text", F.lit(max_chars)) if max_chars else F.col("text"))
    read = read.withColumn("text", body).withColumn("error", F.coalesce("error", F.when(F.col("text") == "", "empty text")))
    good = read.filter("error is null").drop("error").withColumns({"char_count": F.length("text"), "source_id": X.source_id(F.col("text"))})
    return good, read.filter("error is not null").select("path", "error")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt lines) of a JSON-lines file; blank lines are skipped."""
    corrupt = "_corrupt_record"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r"), "value")
    return rows.filter(F.col(f"r.{corrupt}").isNull()).select(*[f"r.{f.name}" for f in schema.fields]), rows.filter(F.col(f"r.{corrupt}").isNotNull()).select("value")


def domain_of(folder: str, names: Mapping[str, str]) -> str:
    """Domain of a folder; its own name if it has none."""
    leaf = folder.rstrip("/").rsplit("/", 1)[-1]
    return names.get(leaf, leaf)


VOCABULARY = "profile string, section string, topic string, topic_ord int, term string, term_ord int"


def vocabulary(spark: SparkSession, profile: str, sections: Mapping[str, Mapping[str, Sequence[str]] | Sequence[str]]) -> DataFrame:
    """A profile's keyword tables as rows; orders are kept, since the first match wins."""
    rows = []
    for section, body in sections.items():
        groups = body.items() if isinstance(body, Mapping) else [("", body)]
        for i, (topic, terms) in enumerate(groups):
            rows += [(profile, section, topic, i, str(t).lower(), j) for j, t in enumerate(terms if isinstance(terms, list | tuple) else [terms])]
    return spark.createDataFrame(rows, VOCABULARY)


def topic_terms(vocab: DataFrame, section: str) -> DataFrame:
    """(topic, terms) of a section."""
    v = vocab.filter(F.col("section") == section).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("term_ord", "term"))).alias("t"), F.min("topic_ord").alias("ord"))
    return v.select("topic", F.transform("t", lambda x: x["term"]).alias("terms"), "ord")


def gold_questions(spark: SparkSession, records: Sequence[Mapping[str, object]]) -> DataFrame:
    """Gold questions from parsed records; single values become lists."""
    listed = lambda v: [] if v in (None, "") else [str(x) for x in v] if isinstance(v, list | tuple) else [str(v)]
    names = ("question_id", "domain", "difficulty", "question")
    lists = ("must_include", "acceptable_alternatives", "must_not_include", "expected_topics", "evaluation_tags")
    rows = [(*[str(r.get(n) or "") for n in names], *[listed(r.get(n)) for n in lists], str(r.get("notes") or "")) for r in records]
    schema = ", ".join([f"{n} string" for n in names] + [f"{n} array<string>" for n in lists] + ["notes string"])
    return spark.createDataFrame(rows, schema)


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows whose key is not in the cache."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


def extraction_key(rows: DataFrame, question: str, chunk: str) -> DataFrame:
    """(question, cache_key) from a question and its sorted chunk ids."""
    g = rows.groupBy(question).agg(F.array_join(F.array_sort(F.collect_list(F.col(chunk).cast("string"))), ",").alias("__c"))
    return g.select(question, X.cache_key(F.col(question), F.col("__c")).alias("cache_key"))


def question_list(text: str) -> list[str]:
    """Questions of a plain list: one a line, with or without a dash, number or quotes; # starts a comment."""
    import re

    found = []
    for line in text.splitlines():
        item = re.sub(r"^\s*(?:[-*]|\d+[.)])\s*", "", line.split("#", 1)[0]).strip().strip("\"'")
        if item and not item.endswith(":"):
            found.append(item.removeprefix("question:").strip().strip("\"'"))
    return found


#: Parts that an engagement must name, and whether each is a list.
ENGAGEMENT = {"title": False, "question": False, "objectives": True, "profiles": True}


def engagement(spec: Mapping[str, object]) -> dict[str, object]:
    """A checked engagement; a missing or misshapen part raises ValueError that names it."""
    out: dict[str, object] = {}
    for name, is_list in ENGAGEMENT.items():
        value = spec.get(name)
        if is_list:
            value = [value] if isinstance(value, str) else list(value or [])
        if not value or (not is_list and not isinstance(value, str)):
            raise ValueError(f"engagement: {name} is missing or has the wrong shape")
        out[name] = value
    return out


def web_chunks(pages: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """One chunk for each page with text, numbered in the order of addresses: web_0000_0000, web_0001_0000, ..."""
    from corvane.operators import select

    kept = select.numbered(pages.filter(F.trim(text) != "").select(url, text), [url, text], "__n", "")
    return kept.select(F.format_string("web_%04d_0000", F.col("__n").cast("long") - 1).alias("chunk_id"), F.col(url).alias("document_name"), F.col(text).alias("chunk_text"), F.lit("web").alias("source_type"))
