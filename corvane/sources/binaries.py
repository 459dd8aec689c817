"""What files say about themselves: metadata embedded in PDF and DOCX files, and vectors in .npy or JSON files.

Files come as rows (path, content), as Spark's binary reader gives them; each is parsed in the task that reads it.  A file that
cannot be read has nulls and an error, never an exception.  Of a PDF the information dictionary is read, plain or in a
compressed object stream, by its own small rules; an encrypted one says nothing.

Cases: null and empty contents are errors (Spark's reader passes over empty files); of several dictionaries the last one counts, as updates are appended; placeholders
in an author's place and internal numbers in a title's are no values; vectors keep their order and are flat.
"""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import decide

META = "path string, kind string, title string, subtitle string, author string, created string, pages int, error string"
#: Fixed value: how a title begins that is a document's internal number.
INTERNAL_TITLE = r"^[A-Z]{2,4}\d{4,}[A-Z_]"
MOST_XML = 1 << 20
_STRING = rb"\s*(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        body = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        one = lambda m: _ESCAPES.get(m[1], bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in b"\r\n" else m[1])
        body = re.sub(rb"\\([0-7]{1,3}|\r\n|[\s\S])", one, raw[1:-1])
    return body.decode("utf-16", "replace") if body[:2] in (b"\xfe\xff", b"\xff\xfe") else body.decode("latin-1")


def _inflated(data: bytes) -> bytes:
    """The file with its compressed object streams laid open behind it."""
    more = []
    for m in re.finditer(rb"/ObjStm\b.{0,400}?stream\r?\n", data, re.DOTALL):
        try:
            more.append(zlib.decompressobj().decompress(data[m.end() :], 1 << 24))
        except zlib.error:
            continue
    return b"\n".join([data, *more])


def _pdf(data: bytes) -> dict:
    if data[:1024].find(b"%PDF-") < 0:
        raise ValueError("no PDF header")
    if b"/Encrypt" in data:
        raise ValueError("encrypted")
    data = _inflated(data)
    info = re.findall(rb"/Info\s+(\d+)\s+(\d+)\s+R", data)
    objects = re.findall(rb"(?:^|\s)%s\s+%s\s+obj\b(.*?)\bendobj" % info[-1], data, re.DOTALL) if info else []
    where = objects[-1] if objects else data
    get = lambda key: _pdf_string(found[-1]) if (found := re.findall(rb"/%s%s" % (key, _STRING), where)) else None
    return {"title": get(b"Title"), "subtitle": get(b"Subject"), "author": get(b"Author"), "created": get(b"CreationDate") or get(b"ModDate"), "pages": len(re.findall(rb"/Type\s*/Page\b", data))}


def _docx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("docProps/core.xml") as f:
        xml = f.read(MOST_XML).decode("utf-8", "replace")
    get = lambda tag: html.unescape(m[1]) if (m := re.search(rf"<{tag}\b[^>]*>([^<]*)</{tag}>", xml)) else None
    return {"title": get("dc:title"), "subtitle": get("dc:subject"), "author": get("dc:creator"), "created": re.sub("-", "", (get("dcterms:created") or "")[:10]) or None, "pages": None}


def _metadata(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["title", "subtitle", "author", "created", "pages"]
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            kind = path.rsplit(".", 1)[-1].lower()
            try:
                found = {"pdf": _pdf, "docx": _docx}[kind](bytes(content))
                rows.append((path, kind, *(found[n] for n in names), None))
            except Exception as e:  # a file that cannot be read is a row with an error
                rows.append((path, kind, *[None] * len(names), f"{type(e).__name__}: {e}"))
        out = pd.DataFrame(rows, columns=["path", "kind", *names, "error"])
        out["pages"] = out["pages"].astype("Int32")
        yield out


def embedded(files: DataFrame) -> DataFrame:
    """path, kind, title, subtitle, author, published (date), pages and error of PDF and DOCX files (path, content)."""
    found = files.select("path", "content").mapInPandas(_metadata, META)
    clean = lambda c: decide.cleaned(F.col(c))
    title = F.when(~F.coalesce(clean("title").rlike(INTERNAL_TITLE), F.lit(True)), clean("title"))
    author = F.when(~decide.skipped_author(clean("author")), clean("author"))
    return found.select("path", "kind", title.alias("title"), clean("subtitle").alias("subtitle"), author.alias("author"), T.pdf_date(F.col("created")).alias("published"), "pages", "error")


def provenance(meta: DataFrame, texts: DataFrame) -> DataFrame:
    """path, title, author, organisation, version, number and published: what a file says of itself, else its text (path, text)."""
    t = texts.select(F.col("path").alias("__p"), T.first_pages(F.col("text"), 3).alias("__t"))
    j = meta.join(t, F.col("path") == F.col("__p"), "left")
    notice = F.regexp_extract("__t", r"(?i)((?:©|copyright)[^\n]{0,160})", 1)
    return j.select("path", "title", "author", T.organisation(notice).alias("organisation"), decide.document_version(F.col("__t")).alias("version"), decide.document_number(F.col("__t")).alias("number"), F.coalesce("published", decide.publication_month(F.col("__t"))).alias("published"))


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                data = bytes(content)
                values = np.load(io.BytesIO(data), allow_pickle=False) if data[:6] == b"\x93NUMPY" else np.array(json.loads(data), dtype=np.float64)
                vector = values.astype(np.float32).ravel().tolist()
            except Exception:  # unreadable is null
                vector = None
            rows.append((path.rsplit("/", 1)[-1].rsplit(".", 1)[0], vector))
        yield pd.DataFrame(rows, columns=["evidence_id", "vector"])


def vectors(files: DataFrame) -> DataFrame:
    """evidence_id (the file's name) and vector of .npy and JSON files (path, content); null where one cannot be read."""
    return files.select("path", "content").mapInPandas(_vectors, "evidence_id string, vector array<float>")


def files_of(spark: SparkSession, folder: str, glob: str = "*.{pdf,docx}") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")
