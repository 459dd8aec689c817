"""Profiles, gold sets and engagements from files.

A file holds one mapping, or several: a JSON document, JSON lines, or YAML documents (where a YAML library is installed).
Spark's binary reader lists and deals the files, so paths may be remote; each file is parsed in the task that reads it and
becomes rows (path, name, folder, ord, body, error): body is the mapping as JSON, and what cannot be parsed is a row with
an error instead of an exception.  Everything else is Column expressions over body.

Cases: a missing or null field has its default; where a list is wanted a single value is a list of one, items lose
blanks (in gold sets also what follows a #) and are dropped if nothing is left; an empty file is an error; a folder without files gives no
rows; files are equal to the reader whatever their order.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
#: A line, as str.splitlines cuts them.
LINE = re.compile("[^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]+")
#: Rows that a task holds at once, and records that a file gets from this library: a file is read whole.
ROWS_AT_ONCE, PER_FILE = 5_000, 20_000
RECORD = "path string, name string, folder string, ord int, body string, error string"


def _mappings(text: str) -> Iterator[tuple[str | None, str | None]]:
    """(body, error) of the mappings in a file, line by line if it has JSON lines."""
    if not text.strip():
        yield None, "empty file"
        return
    try:
        found = [json.loads(text)]
    except ValueError:
        if text.lstrip().startswith("{"):
            for line in LINE.finditer(text):
                if line[0].strip():
                    try:
                        yield _checked(json.loads(line[0]))
                    except ValueError as e:
                        yield None, f"invalid JSON: {e}"
            return
        try:
            import yaml  # optional
        except ModuleNotFoundError:
            yield None, "YAML needs a YAML library"
            return
        try:
            found = [x for x in yaml.safe_load_all(text) if x is not None]
        except yaml.YAMLError as e:
            yield None, f"invalid YAML: {' '.join(str(e).split())}"
            return
    yield from [_checked(x) for x in found] or [(None, "empty file")]


def _checked(value: object) -> tuple[str | None, str | None]:
    if not isinstance(value, dict):
        return None, f"a mapping is wanted, not {type(value).__name__}"
    return json.dumps(value, ensure_ascii=False, default=str), None


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            parts = path.rstrip("/").split("/")
            name, folder = parts[-1].rsplit(".", 1)[0], parts[-2] if len(parts) > 1 else ""
            try:
                found = _mappings(bytes(content).decode("utf-8-sig"))
            except UnicodeDecodeError as e:
                found = iter([(None, f"not UTF-8: {e}")])
            rows = ((path, name, folder, i, body, error) for i, (body, error) in enumerate(found))
            while some := list(itertools.islice(rows, ROWS_AT_ONCE)):
                yield pd.DataFrame(some, columns=["path", "name", "folder", "ord", "body", "error"])


def records(spark: SparkSession, folder: str, glob: str = "*.{yaml,yml,json,txt}") -> DataFrame:
    """All mappings of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "content").mapInPandas(_parse, RECORD)


def field(name: str, default: Column | str | None = "", body: str = "body") -> Column:
    """A field's value as trimmed text."""
    value = F.btrim(F.get_json_object(body, f"$['{name}']"), F.lit(BLANKS))
    return value if default is None else F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def _items(value: Column, comments: bool = False) -> Column:
    """A JSON value as a list of its items' texts; comments: without what follows a #."""
    found = F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    clean = F.transform(found, lambda x: F.btrim(F.regexp_replace(x, "#.*$", "") if comments else x, F.lit(BLANKS)))
    return F.filter(clean, lambda x: x.isNotNull() & (x != ""))


def listed(name: str, body: str = "body") -> Column:
    return _items(F.get_json_object(body, f"$['{name}']"), comments=True)


def plain_list(name: str, body: str = "body") -> Column:
    """A list whose items are kept as they are but for blanks."""
    return _items(F.get_json_object(body, f"$['{name}']"))


def flag(name: str, body: str = "body") -> Column:
    return F.coalesce(F.lower(F.get_json_object(body, f"$['{name}']")).isin("true", "1", "yes"), F.lit(False))


def errors(found: DataFrame) -> DataFrame:
    return found.filter("error is not null").select("path", "ord", "error")


def gold_questions(found: DataFrame) -> DataFrame:
    """Questions of a gold set; id and domain default to the names of file and folder."""
    lists = ("must_include", "acceptable_alternatives", "must_not_include", "expected_topics", "evaluation_tags")
    q = found.filter("error is null")
    return q.select(
        field("question_id", F.col("name")).alias("question_id"), field("domain", F.col("folder")).alias("domain"), field("difficulty", "medium").alias("difficulty"), field("question").alias("question"),
        *[listed(n).alias(n) for n in lists], field("notes").alias("notes"), F.col("path").alias("source_file"),
    )


def contradiction_cases(found: DataFrame) -> DataFrame:
    """Cases of a gold set on contradictions."""
    texts = {"contradiction_id": F.col("name"), "domain": "unknown", "expected_result": "no_contradiction", "category": "unknown", "claim_a": "", "claim_b": "", "severity": None, "entity": "", "entity_a": "", "entity_b": "", "scope_a": "", "scope_b": "", "expected_suppression_reason": None}
    flags = ("suppression_should_fire", "suppression_should_not_fire", "known_limitation")
    return found.filter("error is null").select(*[field(n, d).alias(n) for n, d in texts.items()], *[flag(n).alias(n) for n in flags], F.col("path").alias("source_file"))


#: Sections of a profile whose topics have lists of terms; lists without topics.
BY_TOPIC = ("topic_keywords", "contradiction_topics", "topic_categories", "memo_section_hints", "perspectives", "metric_patterns", "topic_query_expansions", "evaluator_topic_terms", "topic_section_checks", "coverage_gap_keywords", "required_topic_terms", "source_quality_hints", "metric_anchor_queries")
PLAIN = ("coverage_topics", "domain_terms", "specificity_terms", "domain_signals", "entity_patterns")


def profiles(found: DataFrame) -> DataFrame:
    """The profiles: name (else the file's), description, path; of equal names the first path's."""
    p = found.filter("error is null").select(field("name", F.col("name")).alias("profile"), field("description").alias("description"), "path", "body")
    return p.groupBy("profile").agg(F.min_by(F.struct("description", "path", "body"), "path").alias("p")).select("profile", "p.*")


def vocabulary(found: DataFrame) -> DataFrame:
    """(profile, section, topic, topic_ord, term, term_ord): the term tables of the profiles, lower-cased, in their orders.

    A topic's terms are a list, one value, or a mapping with keywords."""
    p = profiles(found).select("profile", "body")
    held = F.array(*[F.struct(F.lit(s).alias("section"), F.get_json_object("body", f"$['{s}']").alias("v")) for s in (*BY_TOPIC, *PLAIN)])
    s = p.select("profile", F.inline(held)).filter("v is not null")
    mapped = s.filter(F.col("v").startswith("{")).select("profile", "section", F.posexplode(F.from_json("v", "map<string,string>")).alias("topic_ord", "topic", "v"))
    plain = s.filter(~F.col("v").startswith("{")).select("profile", "section", F.lit(0).alias("topic_ord"), F.lit("").alias("topic"), "v")
    keywords = F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.keywords")).otherwise(F.col("v"))
    t = mapped.unionByName(plain).select("profile", "section", "topic", "topic_ord", F.posexplode(_items(keywords)).alias("term_ord", "term"))
    return t.select("profile", "section", "topic", "topic_ord", F.lower("term").alias("term"), "term_ord")


def gap_checks(found: DataFrame) -> DataFrame:
    """(profile, area, topic, priority, keywords): research-gap checks; a plain string stands for itself."""
    p = profiles(found).select("profile", F.posexplode(F.from_json(F.get_json_object("body", "$.research_gap_checks"), "map<string,string>")).alias("o", "area", "v"))
    c = p.filter(F.col("v").startswith("[")).select("profile", "area", F.posexplode(F.from_json("v", "array<string>")).alias("i", "c"))
    whole = F.col("c").startswith("{")
    topic = F.when(whole, F.get_json_object("c", "$.topic")).otherwise(F.col("c"))
    words = F.when(whole, _items(F.get_json_object("c", "$.keywords"))).otherwise(F.array(F.lower("c")))
    return c.select("profile", "area", topic.alias("topic"), F.when(whole, F.coalesce(F.get_json_object("c", "$.priority"), F.lit("medium"))).otherwise("medium").alias("priority"), words.alias("keywords"))


def chosen(found: DataFrame, name: str | None = None, default: str = "") -> DataFrame:
    """One profile by its name, or the default one; an error that names what there is, if it is not among them."""
    all_of = profiles(found)
    one = all_of.filter(F.col("profile") == (name or default))
    if not one.limit(1).count():
        raise LookupError(f"no profile {name or default!r}; there are {[r.profile for r in all_of.select('profile').orderBy('profile').limit(50).collect()]}")
    return one
