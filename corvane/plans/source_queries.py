"""Queries over sources that they write from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import html
from corvane.operators import terms, trace
from corvane.plans import carriers as K
from corvane.plans import job_queries
from corvane.plans.catalog import query
from corvane.sources import binaries, records
from corvane.sources.scratch import bounded_broadcast, scratch_path, spread
from corvane.sources.store import Store


def _written(lines: DataFrame, tag: str) -> DataFrame:
    """A column of texts written as text files and read back as records."""
    path = scratch_path(lines.sparkSession, tag)
    lines.write.option("maxRecordsPerFile", records.PER_FILE).text(path)
    return records.records(lines.sparkSession, path)


@query(
    """select coalesce(case when p_partkey % 5 > 0 then 'Q' || p_partkey end, '') question_id, 'domain_' || p_size % 3 domain, case when p_partkey % 4 = 0 then 'hard' else 'medium' end difficulty, 'Which ' || p_type || '?' question,
    case when p_partkey % 3 = 0 then split_part(lower(p_brand), '#', 1) else split_part(lower(p_brand), '#', 1) || '|' || p_size::varchar end must_include, case when p_partkey % 2 = 0 then p_name else '' end alternatives from part where p_partkey % 7 > 0"""
)
def gold_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold questions as JSON lines, single values for lists, comments and broken lines among them."""
    k = F.col("p_partkey")
    brand, size = F.lower("p_brand"), F.col("p_size").cast("string")
    must = F.when(k % 3 == 0, F.to_json(F.struct(F.concat(brand, F.lit(" # the brand")).alias("must_include")))).otherwise(F.to_json(F.struct(F.array(brand, F.lit("# nothing"), size).alias("must_include"))))
    rest = F.to_json(F.struct(
        F.when(k % 5 > 0, F.concat(F.lit("Q"), k)).otherwise("").alias("question_id"), F.concat(F.lit("domain_"), F.col("p_size") % 3).alias("domain"), F.when(k % 4 == 0, "hard").alias("difficulty"),
        F.concat(F.lit(" Which "), "p_type", F.lit("? ")).alias("question"), F.when(k % 2 == 0, F.col("p_name")).alias("acceptable_alternatives"),
    ))
    line = F.when(k % 7 > 0, F.concat(F.regexp_replace(must, r"\}$", ","), F.regexp_replace(rest, r"^\{", ""))).otherwise(F.concat(F.lit("{broken "), k.cast("string")))
    q = records.gold_questions(_written(spread(K.table(spark, sf_dir, "part")).select(line), "gold"))
    return q.select("question_id", "domain", "difficulty", "question", F.array_join("must_include", "|").alias("must_include"), F.array_join("acceptable_alternatives", "|").alias("alternatives"))


@query("select p_partkey::varchar part, 'invalid JSON' kind from part where p_partkey % 7 = 0 union all select p_partkey::varchar, 'a mapping is wanted, not list' from part where p_partkey % 7 = 1")
def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that cannot be read are rows."""
    k = F.col("p_partkey")
    # a list stands in a line after a mapping: a file that begins with a list holds no JSON lines
    line = F.when(k % 7 == 0, F.concat(F.lit('{"id": '), k, F.lit(", oops}"))).when(k % 7 == 1, F.concat(F.lit("{}\n["), k, F.lit("]"))).otherwise(F.concat(F.lit('{"id": '), k, F.lit("}")))
    # a broken line is known by its place in the text file only; its number is read from the file again
    path = scratch_path(spark, "lines")
    spread(K.table(spark, sf_dir, "part")).select(line).write.option("maxRecordsPerFile", records.PER_FILE).text(path)
    broken = records.errors(records.records(spark, path)).select("path", "ord", F.regexp_extract("error", "^(invalid JSON|.*)", 1).alias("kind"))
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return broken.join(whole, (name(F.col("path")) == name(F.col("file"))) & (F.col("ord") == F.col("at"))).select(F.regexp_extract("line", r"(\d+)", 1).alias("part"), "kind")


_PROFILE_SQL = "select 'market_' || c_mktsegment profile, 'n' || c_nationkey topic, lower(c_name) term, row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey) - 1 term_ord from customer"


@query(_PROFILE_SQL)
def profile_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of topics and terms, written as files and read back as a vocabulary."""
    return records.vocabulary(_profile_files(spark, sf_dir)).filter("section = 'topic_keywords'").select("profile", "topic", "term", F.col("term_ord").cast("long").alias("term_ord"))


def _profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("l"))
    c = c.groupBy("c_mktsegment").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), "c_nationkey"), F.transform("l", lambda x: x["c_name"])))).alias("topic_keywords"))
    checks = F.lit('{"supply": ["Grid", {"topic": "chips", "keywords": ["gpu", "wafer"], "priority": "high"}], "none": "x"}')
    body = F.to_json(F.struct(F.concat(F.lit("market_"), "c_mktsegment").alias("name"), "topic_keywords"))
    return _written(c.select(F.concat(F.regexp_replace(body, r"\}$", ', "research_gap_checks": '), checks, F.lit("}"))), "profiles")


@query("select distinct 'market_' || c_mktsegment profile, 'supply' area, x.topic, x.priority, x.keywords from customer, (values ('Grid', 'medium', 'grid'), ('chips', 'high', 'gpu|wafer')) x(topic, priority, keywords)")
def profile_gap_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = records.gap_checks(_profile_files(spark, sf_dir))
    return g.select("profile", "area", "topic", "priority", F.array_join("keywords", "|").alias("keywords"))


@query(
    f"""with v as ({_PROFILE_SQL}), t as (select o_orderkey, 'Order of ' || c_name || '.' claim from orders join customer on o_custkey = c_custkey)
    select profile, topic, count(distinct o_orderkey) claims from v join customer on lower(c_name) = term join orders on o_custkey = c_custkey group by all"""
)
def profile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on orders, scored by the topics of the profiles that were read from files."""
    v = records.vocabulary(_profile_files(spark, sf_dir)).filter("section = 'topic_keywords'").select("term", F.concat_ws("/", "profile", "topic").alias("label"))
    said = K.table(spark, sf_dir, "orders").join(bounded_broadcast(K.table(spark, sf_dir, "customer")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat(F.lit("Order of "), "c_name", F.lit(".")).alias("claim"))
    held = terms.labelled(said, "claim", v).select("o_orderkey", F.explode("labels").alias("l"))
    return held.groupBy(F.split("l", "/")[0].alias("profile"), F.split("l", "/")[1].alias("topic")).agg(F.count("*").alias("claims"))


@query(
    """select p_partkey::varchar || '.pdf' path, case when p_partkey % 4 > 0 then p_name || ' (' || p_size || ')' end title, case when p_partkey % 3 > 0 then p_brand end author, case when p_partkey % 5 > 0 then '20' || lpad((p_size % 30)::varchar, 2, '0') || '-03-15' end published,
    p_size % 4 pages from part where p_partkey % 11 > 0"""
)
def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of small PDF files made of a table; placeholders, internal titles and broken files among them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    title = F.when(k % 4 > 0, F.concat(F.lit("("), "p_name", F.lit(r" \("), size.cast("string"), F.lit(r"\))"))).otherwise("(ABC12345_draft)")
    author = F.when(k % 3 > 0, F.concat(F.lit("<FEFF"), F.regexp_replace(F.hex("p_brand"), "(..)", "00$1"), F.lit(">"))).otherwise("(Adobe InDesign)")
    stamp = F.when(k % 5 > 0, F.concat(F.lit("(D:20"), F.lpad((size % 30).cast("string"), 2, "0"), F.lit("0315120000)"))).otherwise("()")
    info = F.concat(F.lit("7 0 obj << /Title "), title, F.lit(" /Author "), author, F.lit(" /CreationDate "), stamp, F.lit(" >> endobj\n"))
    body = F.concat(F.when(k % 11 > 0, "%PDF-1.4\n").otherwise("%DOC\n"), F.lit("9 0 obj << /Title (not this) >> endobj\n"), info, F.repeat(F.lit("3 0 obj << /Type /Page >> endobj\n"), (size % 4).cast("int")), F.lit("4 0 obj << /Type /Pages >> endobj\ntrailer << /Info 7 0 R >>\n%%EOF"))
    files = K.table(spark, sf_dir, "part").select(F.concat(k.cast("string"), F.lit(".pdf")).alias("path"), body.cast("binary").alias("content"))
    found = binaries.embedded(files).filter("error is null")
    return found.select("path", "title", "author", F.col("published").cast("string").alias("published"), "pages")


@query("select vec_id::varchar evidence_id, case when vec_id % 7 > 0 then len(embedding) end n, case when vec_id % 7 > 0 then round(list_sum(embedding)::double, 3) end total from embeddings")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of files; what cannot be read is null."""
    body = F.when(F.col("vec_id") % 7 > 0, F.to_json("embedding")).otherwise("[1, oops")
    files = K.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("store/"), F.col("vec_id").cast("string"), F.lit(".json")).alias("path"), body.cast("binary").alias("content"))
    v = binaries.vectors(files)
    return v.select("evidence_id", F.when(F.col("vector").isNotNull(), F.size("vector")).cast("long").alias("n"), F.round(F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query(f"with {job_queries.MAIN_TEXT_SQL} select page_id, length(text) n, md5(text) digest from main")
def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of pages, by the density of their blocks."""
    t = K.table(spark, sf_dir, "pages").select("page_id", html.main_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


def _built(spark: SparkSession, sf_dir: str) -> tuple[Store, list[tuple[str, int, int]]]:
    """A store of two domains: a build of some documents, then one of all, of which every seventh has changed."""
    store, counts = Store(spark, scratch_path(spark, "store")), []
    d = K.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("uri"), "text", F.when(F.col("lang") == "en", "english").otherwise("other").alias("domain"))
    for n in range(2):
        for domain in ("english", "other"):
            some = d.filter((F.col("domain") == domain) & (F.lit(n == 1) | (F.col("doc_id") % 2 == 0)))
            text = F.when((F.col("doc_id") % 7 == 0) & F.lit(n == 1), F.concat(F.lit("New text. "), "text")).otherwise(F.col("text"))
            got = store.build(some.select("uri", text.alias("text")), domain, f"{domain}-{n}")
            counts.append((f"{domain}-{n}", got["documents"], got["skipped"]))
    return store, counts


_STORED_SQL = """d as (select doc_id, text, case when lang = 'en' then 'english' else 'other' end dom from documents where text is not null),
    b as (select 0 n, * from d where doc_id % 2 = 0 union all select 1, doc_id, case when doc_id % 7 = 0 then 'New text. ' || text else text end, dom from d),
    f as (select n, dom, text, min(doc_id::varchar) uri from b group by all), s as (select *, exists (select 1 from f o where o.n < f.n and o.dom = f.dom and o.text = f.text and o.n = 0) seen from f)"""


@query(f"with {_STORED_SQL} select dom || '-' || n run_id, count(*) scanned, count(*) filter (where seen) skipped, round(count(*) filter (where seen) / count(*)::double, 3) ratio from s group by dom, n")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each build scanned and skipped, and the share that it found in the store."""
    _, counts = _built(spark, sf_dir)
    t = spark.createDataFrame([(r, m, float(v)) for r, n, k in counts for m, v in (("scanned", n), ("skipped", k))], "run_id string, metric string, value double")
    wide = t.groupBy("run_id").agg(*[F.sum(F.when(F.col("metric") == m, F.col("value"))).cast("long").alias(m) for m in ("scanned", "skipped")])
    return wide.join(trace.hit_ratio(t), "run_id")


@query(
    f"""with {_STORED_SQL}, w as (select dom, uri, text, n, row_number() over (partition by dom, uri order by n desc) r from s where not seen), l as (select dom, text, max(n) n from w where r = 1 group by all)
    select dom as domain_name, count(*) sources, 2 runs, 1.0::double completed, true ready from l group by dom"""
)
def store_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of a store: sources in force, runs, readiness."""
    store, _ = _built(spark, sf_dir)
    r = store.report().join(store.health().select("domain", "ready"), "domain")
    return r.select(F.col("domain").alias("domain_name"), "sources", F.col("runs").cast("int").alias("runs"), "completed", "ready")
