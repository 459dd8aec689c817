"""Queries over documents and pages: text functions, chunks, signals, extraction, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import chunking, classify, evidence, score, select
from corvane.plans import carriers as K
from corvane.plans.catalog import query

_COMPACT = K.COMPACT_SQL.format(x="text")


@query(
    f"""select doc_id, substr(sha256(text), 1, 32) source_id, substr(sha256(lower({_COMPACT})), 1, 16) fingerprint, length({_COMPACT}) n,
    substr(sha256('q|' || doc_id::varchar), 1, 16) cache_key from documents"""
)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return K.table(spark, sf_dir, "documents").select(
        "doc_id", T.source_id(t).alias("source_id"), T.fingerprint(t).alias("fingerprint"), F.length(T.compact(t)).alias("n"), T.cache_key(F.lit("q"), F.col("doc_id").cast("string")).alias("cache_key")
    )


def _tokens_sql(x: str, pattern: str, stop: tuple, least: int = 1) -> str:
    keep = f"length(w) >= {least}" + (f" and w not in ({', '.join(map(K.quoted, stop))})" if stop else "")
    return f"list_filter(regexp_extract_all(lower({x}), {K.quoted(pattern)}), lambda w: {keep})"


@query(
    f"""select doc_id, len(list_distinct({_tokens_sql("text", "[a-z][a-z0-9-]{2,}", L.QUESTION_STOP)})) keywords, len({_tokens_sql("text", "[a-z][a-z0-9'-]*", L.QUERY_STOP, 2)}) query_terms,
    sha256(array_to_string(list_sort(list_distinct({_tokens_sql("text", "[a-z0-9]+", L.QUERY_STOP, 3)})), ' ')) token_set from documents"""
)
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return K.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(T.keywords(t)).alias("keywords"),
        F.size(T.query_terms(t)).alias("query_terms"),
        F.sha2(F.array_join(F.array_sort(T.tokens(t, "[a-z0-9]+", L.QUERY_STOP, 3, distinct=True)), " "), 256).alias("token_set"),
    )


_JSET = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 1))"


@query(
    f"""with b as (select item_id, {_JSET.format(x="text")} s from benchmark)
    select a.item_id a, b.item_id b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::double, 6) jaccard, len(list_intersect(a.s, b.s)) overlap
    from b a join b b on b.item_id = a.item_id + 1 where len(a.s) > 0 and len(b.s) > 0"""
)
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = K.table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text"), "[a-z0-9]+", least=2, distinct=True).alias("s")).filter("size(s) > 0")
    x, y = b.alias("x"), b.alias("y")
    j = x.join(y, F.col("y.item_id") == F.col("x.item_id") + 1)
    return j.select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.round(T.jaccard(F.col("x.s"), F.col("y.s")), 6).alias("jaccard"), T.overlap(F.col("x.s"), F.col("y.s")).alias("overlap"))


def _html_sql() -> str:
    t = "html"
    for tag in ("script", "style", "nav", "header", "footer", "aside", "noscript"):
        t = rf"regexp_replace({t}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = f"replace({t}, {K.quoted(entity)}, {K.quoted(char)})"
    return K.COMPACT_SQL.format(x=t)


@query(
    rf"""select page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)) title, {_html_sql()} body, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) slug from pages"""
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "pages").select("page_id", T.title(F.col("html")).alias("title"), T.html_text(F.col("html")).alias("body"), T.url_slug(F.col("url")).alias("slug"))


_ENDS = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])([ \t\n\x0b\f\r])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: length(x)), lambda x: true)"


@query(
    rf"""with recursive d as (select doc_id, text, length(text) n, string_split(regexp_replace(text, '([.!?])([ \t\n\x0b\f\r])', '\1' || chr(1) || '\2', 'g'), chr(1)) p from documents where length(text) > 0),
    e as (select doc_id, n, list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::bigint) ends from d),
    c as (select doc_id, n, ends, 1 chunk_number, 0::bigint start_offset, (case when n <= 800 then n else coalesce(list_min(list_filter(ends, lambda x: x >= 700 and x < 800)), list_max(list_filter(ends, lambda x: x > 0 and x < 800)), 800) end)::bigint end_offset from e
      union all select doc_id, n, ends, chunk_number + 1, end_offset, (case when end_offset + 800 >= n then n else coalesce(list_min(list_filter(ends, lambda x: x >= end_offset + 700 and x < end_offset + 800)),
        list_max(list_filter(ends, lambda x: x > end_offset and x < end_offset + 800)), end_offset + 800) end)::bigint from c where end_offset < n)
    select c.doc_id, chunk_number, start_offset, end_offset, md5(substr(text, start_offset + 1, end_offset - start_offset)) digest from c join d on c.doc_id = d.doc_id"""
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(K.table(spark, sf_dir, "documents"), 700, 800)
    return c.select("doc_id", "chunk_number", "start_offset", "end_offset", F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


_SIG = ", ".join(f"{K.sql_count('t', p)} s_{n}" for n, p in classify.SIGNALS)
_PIECES = r"list_filter(list_transform(regexp_split_to_array(t, '[.!?\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))), lambda x: x <> '')"
#: word boundaries of the checking dialect know ASCII only, so accented letters become word characters of no class
_ASCII = "regexp_replace({x}, '[À-ÖØ-öø-ɏ]', '_', 'g')"
_CLASS = f"""with d as (select doc_id, {_ASCII.format(x="text")} t from documents), s as (select *, {_SIG} from d),
    q as (select *, s_numeric + s_entity + s_date + s_unit + s_comparative + s_policy total, {K.sql_pattern_hits("t", L.HARD_BOILERPLATE)} >= 1 hard, {_PIECES} pieces from s),
    b as (select *, least(total / 10.0::double, 1.0::double) strength, (length(trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) < 150 or {K.sql_pattern_hits("t", L.TOC)} >= 2 or {K.sql_pattern_hits("t", L.LEGAL)} >= 2 or {K.sql_pattern_hits("t", L.NAVIGATION)} >= 3
      or (len(pieces) >= 5 and len(list_filter(pieces, lambda x: len(regexp_split_to_array(x, '\\s+')) <= 8)) / len(pieces)::double > 0.6)) boiler from q),
    k as (select *, case when not hard and (s_numeric >= 10 or s_unit >= 8 or s_policy >= 10 or s_entity >= 75) then 'evidence_dense/high' when hard or boiler then 'boilerplate/skip'
      when {K.sql_pattern_hits("t", L.REFERENCES)} >= 2 then 'reference/skip' when {K.sql_pattern_hits("substr(t, 1, 400)", L.PRIORITY_HEADERS)} >= 1 then 'evidence_dense/high'
      when strength >= 0.6 or (s_numeric >= 3 and s_unit >= 2) then 'evidence_dense/high' when strength >= 0.3 or s_numeric >= 1 or s_policy >= 1 then 'evidence_dense/medium' else 'context/low' end class from b)"""


@query(f"{_CLASS} select doc_id, s_numeric, s_entity, s_date, s_unit, s_comparative, s_policy, total, least(100, s_numeric + s_entity + 3 * s_unit + 2 * s_policy + s_date + 2 * s_comparative) strength, class from k")
def classify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, as chunks, with signals and class."""
    c = classify.classified(K.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    s = F.col("signals")
    return c.select("doc_id", *[s[n].alias(f"s_{n}") for n, _ in classify.SIGNALS], classify.signal_total(s).alias("total"), score.signal_strength(s).alias("strength"), F.concat_ws("/", "chunk_type", "priority").alias("class"))


_TERMS = ("that", "with", "from", "qui", "aquel")
_GROUPS = (("alpha", ("thonen", "ingth")), ("beta", ("eaux", "ciones")), ("gamma", ("keit", "heit")), ("delta", ("license", "rights")))
_SENT = K.SENTENCES_SQL.format(x="text")


def _topic_share(x: str) -> str:
    return "(" + " + ".join(f"{K.sql_any(x, t)}::int" for _, t in _GROUPS) + f") / {len(_GROUPS)}.0::double"


_QUALITY = "1 + cast(substr(source, 4) as int) % 5"
_SCORED = f"""select doc_id, source, n_chars, round({K.sql_hits("text", _TERMS)} / {len(_TERMS)}.0::double, 4) relevance, len(list_filter({_SENT}, lambda s: {K.sql_any("s", _TERMS)})) candidates,
    {_topic_share("text")} topic, {_QUALITY} quality from documents"""
_RETRIEVED = f"select *, round(0.40::double * relevance + 0.35::double * topic + 0.25::double * quality / 5.0::double, 4) score from ({_SCORED})"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    quality = 1 + F.substring("source", 4, 9).cast("int") % 5
    d = K.table(spark, sf_dir, "documents").select(
        "doc_id", "source", "n_chars", score.chunk_relevance(t, _TERMS).alias("relevance"), score.candidate_sentences(t, _TERMS).alias("candidates"), score.topic_match(t, _GROUPS).alias("topic"), quality.alias("quality")
    )
    return d.withColumn("score", score.retrieval_score(F.col("relevance"), F.col("topic"), F.col("quality")))


@query(f"select doc_id, relevance, candidates, round(topic, 4) topic, score from ({_RETRIEVED})")
def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "relevance", "candidates", F.round("topic", 4).alias("topic"), "score")


@query(
    f"""with r as ({_RETRIEVED}), top as (select * from r order by score desc, doc_id limit 12),
    best as (select * from (select *, row_number() over (partition by source order by score desc, doc_id) rn from r) where rn = 1 and score >= 0.3 and source not in (select source from top))
    select doc_id, source, score, 'top' reason from top union all select doc_id, source, score, 'coverage' from best"""
)
def top_chunks_with_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.with_group_guarantee(_scored(spark, sf_dir), "source", "score", "doc_id", 12, 0.3).select("doc_id", "source", "score", "reason")


_QUERIES = (("q1", ("that", "with")), ("q2", ("eaux", "qui")), ("q3", ("keit", "und")))


@query(
    f"""with r as ({" union all ".join(f"select {K.quoted(q)} query, doc_id, source, round({K.sql_hits('text', t)} / {len(t)}.0::double, 4) score from documents" for q, t in _QUERIES)}),
    w as (select *, row_number() over (partition by query order by score desc, doc_id) rn, row_number() over (partition by query, source order by score desc, doc_id) gn from r),
    c as (select *, min(rn) over (partition by query, source) <= 8 covered from w)
    select doc_id, max(score) score, count(*) queries from c where rn <= 8 or (not covered and gn = 1 and score >= 0.3) group by doc_id"""
)
def merged_query_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.table(spark, sf_dir, "documents")
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("query"), score.chunk_relevance(F.col("text"), t).alias("score")) for q, t in _QUERIES])).alias("m")
    r = d.select("doc_id", "source", each).select("doc_id", "source", "m.*")
    return select.merged_queries(r, "query", "source", "score", "doc_id", 8, 0.3)


@query(
    f"""with r as ({_RETRIEVED}), w as (select *, row_number() over (partition by source order by score desc, doc_id) n from r), p as (select *, case when n = 1 then 1 when n <= 3 then 2 else 3 end pass from w)
    select doc_id, source, pass from p order by pass, score desc, doc_id limit 50"""
)
def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.diverse(_scored(spark, sf_dir), "source", [F.desc("score"), F.asc("doc_id")], 50, 3).select("doc_id", "source", "pass")


_TOPICS = (("stop", ("that", " the ")), ("gallic", ("eaux", " les ")), ("teutonic", ("keit", " und ")), ("iberian", ("ciones", " que ")))


def _labelled(x: str) -> str:
    return f"list_filter([{', '.join(f'case when {K.sql_any(x, t)} then {K.quoted(n)} end' for n, t in _TOPICS)}], lambda x: x is not null)"


_TOPIC_SQL = f"""with d as (select doc_id, {_COMPACT} t from documents where {_COMPACT} <> ''),
    p as (select doc_id, unnest(a) s, generate_subscripts(a, 1) pos from (select doc_id, list_filter({K.SENTENCES_SQL.format(x="t")}, lambda s: length(s) >= 40) a from d)),
    x as (select doc_id, pos, substr(s, 1, 500) snippet, unnest({_labelled("substr(s, 1, 100000)")}) topic from p),
    y as (select *, row_number() over (partition by doc_id, topic, substr(snippet, 1, 100) order by pos) rn from x), s1 as (select doc_id, topic, snippet, row_number() over (partition by doc_id, topic order by pos) n from y where rn = 1),
    w as (select doc_id, unnest(list_transform(range(0, greatest(length(t), 1), 400), lambda i: trim(substr(t, i + 1, 500)))) s, unnest(range(1, greatest(length(t) - 1, 0) // 400 + 2)) pos from d),
    wx as (select doc_id, pos, s snippet, unnest({_labelled("s")}) topic from w where s <> ''), wy as (select *, row_number() over (partition by doc_id, topic, substr(snippet, 1, 100) order by pos) rn from wx),
    s2 as (select doc_id, topic, snippet, row_number() over (partition by doc_id, topic order by pos) n from wy where rn = 1),
    ts as (select doc_id, topic, n, snippet, false as win from s1 where n <= 4 union all select doc_id, topic, n, snippet, true from s2 where n <= 4 and (doc_id, topic) not in (select (doc_id, topic) from s1))"""


@query(f"{_TOPIC_SQL} select doc_id, topic, n, md5(snippet) digest, win as is_window from ts")
def topic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chunking.topic_sentences(K.table(spark, sf_dir, "documents"), _TOPICS)
    return s.select("doc_id", "topic", "n", F.md5(F.col("snippet").cast("binary")).alias("digest"), F.col("window").alias("is_window"))


_FALLBACK_SQL = f"""fd as (select doc_id, {_COMPACT} t from documents), fe as (select doc_id, t, list_transform(list_filter({K.SENTENCES_SQL.format(x="t")}, lambda s: length(s) >= 40), lambda s: substr(s, 1, 500))[1:12] s,
      list_filter(list_transform(range(0, greatest(length(t), 1), 500), lambda i: trim(substr(t, i + 1, 500))), lambda x: length(x) >= 40) w, least(length(t), greatest(40, length(t) * 2 // 3)) width from fd),
    fg as (select doc_id, t, s, width, list_filter(w, lambda x, i: not list_contains(s, x) and list_position(w, x) = i) m from fe),
    fh as (select doc_id, t, case when len(s) < 4 then list_concat(s, m[1:4 - len(s)]) else s end s, width from fg),
    fi as (select doc_id, s, case when length(t) >= 40 then [trim(left(t, width)), trim(right(t, width))] else [] end e from fh),
    fj as (select doc_id, s, list_filter(e, lambda x, i: not list_contains(s, x) and list_position(e, x) = i) m from fi),
    fk as (select doc_id, (case when len(s) < 4 then list_concat(s, m[1:4 - len(s)]) else s end)[1:12] a from fj), fallback as (select doc_id, unnest(range(0, len(a))) n, unnest(a) snippet from fk)"""


@query(f"with {_FALLBACK_SQL} select doc_id, n, md5(snippet) digest from fallback")
def fallback_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chunking.snippets(K.table(spark, sf_dir, "documents"), 4, 12)
    return s.select("doc_id", "n", F.md5(F.col("snippet").cast("binary")).alias("digest"))


_HOLDS = K.sql_any("x", ("license", "keit"))


@query(
    f"""with d as (select doc_id, {_COMPACT} t from documents), e as (select doc_id, t, list_filter({K.SENTENCES_SQL.format(x="t")}, lambda x: length(x) >= 40 and {_HOLDS})[1] s,
      list_filter(list_transform(range(0, greatest(length(t), 1), 500), lambda i: trim(substr(t, i + 1, 500))), lambda x: {_HOLDS})[1] w from d)
    select doc_id, md5(coalesce(substr(s, 1, 500), w, substr(t, 1, 500))) digest from e where {K.sql_any("t", ("license", "keit"))}"""
)
def first_topic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.table(spark, sf_dir, "documents").select("doc_id", chunking.first_topic_chunk(T.compact(F.col("text")), ("license", "keit")).alias("s"))
    return d.filter("s is not null").select("doc_id", F.md5(F.col("s").cast("binary")).alias("digest"))


@query(
    rf"""with p as (select doc_id, unnest(a) sentence, generate_subscripts(a, 1) pos from (select doc_id, list_filter({_SENT}, lambda s: length(s) >= 40) a from documents)),
    r as (select *, {K.sql_first_pattern(_ASCII.format(x="sentence"), L.RECOVERY_REASONS, "other")} reason from p), f as (select *, row_number() over (partition by doc_id, substr(sentence, 1, 100) order by pos) d from r where reason <> 'other')
    select doc_id, n, reason, md5(sentence) digest from (select *, row_number() over (partition by doc_id order by pos) n from f where d = 1) where n <= 4"""
)
def recovered_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evidence.recovered(K.table(spark, sf_dir, "documents"), "text", ("doc_id",))
    return r.select("doc_id", "n", "reason", F.md5(F.col("sentence").cast("binary")).alias("digest"))


@query(
    rf"""select doc_id, (length(trim(text)) < 50 or length(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g')) / greatest(length(text), 1)::double < 0.70) garbled,
    left(array_to_string(({K.SENTENCES_SQL.format(x=_COMPACT)})[1:2], ' '), 200) condensed, array_to_string(list_transform(regexp_extract_all(text, '\[Source:\s*[^\]]*?Evidence:\s*(E\d{{3,}})[^\]]*\]', 1), lambda x: x), ',') cited,
    translate(lower(source || '_A-b'), '_-', '  ') score_text from documents"""
)
def text_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return K.table(spark, sf_dir, "documents").select(
        "doc_id", T.garbled(t).alias("garbled"), T.condensed(t, 2, 200).alias("condensed"), F.array_join(T.citations(t), ",").alias("cited"), T.score_text(F.concat("source", F.lit("_A-b"))).alias("score_text")
    )


#: document kinds rendered from parts: a notice, a revision, a date, pages
_NOTICE = "case p_partkey % 4 when 0 then '© 2024 ' || p_name || ' LLC. All rights reserved.' when 1 then 'Copyright 2019-2021 ' || p_brand || '.' when 2 then 'no notice' else '© 2020 Abc.' end"


@query(
    rf"""with p as (select p_partkey id, {_NOTICE} notice, 'D:20' || lpad((p_size % 30)::varchar, 2, '0') || lpad((p_size % 14)::varchar, 2, '0') || '15' stamp, '[Page 1] ' || p_name || ' [Page 2] ' || p_type || ' [Page 3] end' pages from part),
    o as (select *, trim(regexp_replace(regexp_replace(trim(regexp_replace(notice, '(?i)^(?:©|copyright\s*©?)\s*(?:\d{{4}}[-–]\d{{4}}|\d{{4}})\s*', '')), '(?i)\.\s*(?:all rights reserved|used under).*$', ''), '[.,;]+$', '')) org from p)
    select id, case when length(org) > 3 then org end organisation, coalesce(case when length(org) > 3 then org end, 'unknown') publisher, try_cast(try_strptime(regexp_extract(stamp, '(\d{{8}})', 1), '%Y%m%d') as date)::varchar published,
    substr(pages, 1, strpos(pages, '[Page 3]') - 1) first_two from o"""
)
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = K.table(spark, sf_dir, "part").selectExpr(
        "p_partkey id", f"{_NOTICE} notice", "concat('D:20', lpad(cast(p_size % 30 as string), 2, '0'), lpad(cast(p_size % 14 as string), 2, '0'), '15') stamp", "concat('[Page 1] ', p_name, ' [Page 2] ', p_type, ' [Page 3] end') pages"
    )
    org = T.organisation(F.col("notice"))
    return p.select("id", org.alias("organisation"), F.coalesce(org, F.lit("unknown")).alias("publisher"), T.pdf_date(F.col("stamp")).cast("string").alias("published"), T.first_pages(F.col("pages"), 2).alias("first_two"))


@query(
    """select event_id, coalesce(case when json_valid(f) then f end, case when json_valid(w) then w end, case when json_valid(b) then b end) found, n from (
    select event_id, trim(regexp_extract(t, '(?s)```(?:json)?\\s*(.*?)```', 1)) f, trim(t) w, regexp_extract(t, '(?s)(\\{.*\\})', 1) b, n from (select event_id, case event_id % 4 when 0 then 'Here: ```json ' || props || ' ```' when 1 then props
      when 2 then 'answer ' || props || ' done' else 'none' end t, case when event_id % 2 = 0 then 2 else 1 end n from events))"""
)
def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K.table(spark, sf_dir, "events")
    m = F.col("event_id") % 4
    t = F.when(m == 0, F.concat(F.lit("Here: ```json "), "props", F.lit(" ```"))).when(m == 1, F.col("props")).when(m == 2, F.concat(F.lit("answer "), "props", F.lit(" done"))).otherwise("none")
    listed = F.when(F.col("event_id") % 2 == 0, '["a", "b"]').otherwise("a")
    return e.select("event_id", T.json_value(t).alias("found"), F.size(T.string_list(listed)).alias("n"))


@query(
    """with n as (select n_regionkey, list_concat(list(n_name order by n_nationkey), list(lower(n_name) order by n_nationkey)) a, list(n_name order by n_nationkey) b from nation group by n_regionkey)
    select n_regionkey, array_to_string(b, ',') names, 'REC-' || lpad(n_regionkey::varchar, 3, '0') rec from n"""
)
def list_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = K.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    names = F.transform("l", lambda x: x["n_name"])
    n = n.select("n_regionkey", F.concat(names, F.transform(names, F.lower)).alias("a"))
    return n.select("n_regionkey", F.array_join(T.distinct_ignoring_case(F.col("a")), ",").alias("names"), T.recommendation_id(F.concat(F.lit("recommendation "), F.col("n_regionkey").cast("string"))).alias("rec"))


_NAMES = ("NVIDIA Technical Blog.pdf", "nvidia keynote.pdf", "StorageReview NVIDIA GB200 Analysis.pdf", "Vendor Whitepaper.pdf", "market analysis.pdf", "daily news.txt", "test_power_a.txt", "notes.txt", "smr report.pdf")
_NAME = f"[{', '.join(map(K.quoted, _NAMES))}][s_suppkey % {len(_NAMES)} + 1] || ' ' || s_suppkey::varchar || case s_suppkey % 2 when 0 then '.txt' else '.pdf' end"


def _quality_sql(i: int) -> str:
    rows = " ".join(f"when {' and '.join(f'contains(lower(name), {K.quoted(t)})' for t in terms)} then {K.quoted(kind) if i == 0 else q}" for terms, kind, q in L.SOURCE_QUALITY)
    return f"case {rows} when suffix(lower(name), '.txt') then {K.quoted('synthetic') if i == 0 else 1} else {K.quoted('unknown') if i == 0 else 2} end"


@query(f"select id, {_quality_sql(0)} source_type, {_quality_sql(1)} quality, case when {K.sql_any('name', L.SMR_SIGNALS)} then 'smr' else 'ai_dc' end as domain_name from (select s_suppkey id, {_NAME} as name from supplier)")
def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.table(spark, sf_dir, "supplier")
    name = F.concat(F.get(F.array(*map(F.lit, _NAMES)), (F.col("s_suppkey") % len(_NAMES)).cast("int")), F.lit(" "), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".txt").otherwise(".pdf"))
    q = s.select(F.col("s_suppkey").alias("id"), classify.source_quality(name).alias("q"), classify.domain(name).alias("domain_name"))
    return q.select("id", "q.source_type", "q.quality", "domain_name")


_QUESTIONS = ("What factors drive LCOE in {x}?", "Compare {x} versus NVL72 rack power", "Why does {x} need liquid cooling?", "How many GPUs integrated in GB200 NVL72 for {x}?", "What is the construction cost of BWRX-300 at {x}?", "{x} electrical output in mwe", "Tell me everything that is known about the deployment of very large clusters in {x} and their supply", "What are the main bandwidth limits of {x}?")


def _question_sql() -> str:
    words = "regexp_extract_all(lower(q), '[a-z][a-z0-9-]{1,}')"
    stop = ", ".join(map(K.quoted, L.QUERY_STOP))
    explore = ", ".join(map(K.quoted, L.EXPLORATORY))
    modes = " ".join(f"when regexp_matches(q, {K.quoted(p)}) then {K.quoted(m)}" for m, p in L.QUESTION_MODES)
    locks = " ".join(f"when {' or '.join(f'contains(q, {K.quoted(s)})' for s in spell)} then {K.quoted(n)}" for n, spell in L.ENTITY_LOCKS)
    metrics = " ".join(f"when regexp_matches(q, {K.quoted(p)}) then {K.quoted(n)}" for n, p in L.METRIC_LOCKS)
    return f"""select id, case when list_has_any({words}, [{explore}]) or regexp_matches(q, {K.quoted(L.EXPLORATORY_PHRASE)}) then 'EXPLORATORY_RESEARCH' {modes}
      when len(list_filter({words}, lambda w: w not in ({stop}))) <= 8 then 'FACT_LOOKUP' else 'EXPLORATORY_RESEARCH' end as mode_, case {locks} end as entity_lock, case {metrics} end as metric_lock
      from (select n_nationkey id, replace([{", ".join(map(K.quoted, _QUESTIONS))}][n_nationkey % {len(_QUESTIONS)} + 1], '{{x}}', n_name) q from nation)"""


@query(_question_sql())
def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.replace(F.get(F.array(*map(F.lit, _QUESTIONS)), F.col("n_nationkey") % len(_QUESTIONS)), F.lit("{x}"), F.col("n_name"))
    n = K.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), q.alias("q"))
    c = F.col("q")
    return n.select("id", classify.question_mode(c).alias("mode_"), classify.entity_lock(c).alias("entity_lock"), classify.metric_lock(c).alias("metric_lock"))


@query(
    f"""with e as (select doc_id, source, {_QUALITY} q, lower(text) low from documents), t(topic, terms) as (values ('stop', ['that', ' the ']), ('gallic', ['eaux', ' les ']), ('licence', ['all rights reserved']), ('absent', ['zzqzz'])),
    h as (select topic, source, count(*) n, max(q) q from e, t where len(list_filter(terms, lambda k: contains(low, k))) > 0 group by all), g as (select topic, sum(n) n, count(*) s, avg(q) q from h group by topic)
    select t.topic, coalesce(n, 0)::bigint evidence_count, coalesce(s, 0) source_count, round(coalesce(q, 3.0), 4) avg_quality, case when coalesce(n, 0) = 0 then 'none' when n = 1 then 'weak' when n >= 5 and s >= 2 then 'strong' else 'moderate' end as level_ from t left join g on t.topic = g.topic"""
)
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K.table(spark, sf_dir, "documents").select("source", F.col("text").alias("snippet"), (1 + F.substring("source", 4, 9).cast("int") % 5).alias("quality"))
    topics = spark.createDataFrame([("stop", ["that", " the "]), ("gallic", ["eaux", " les "]), ("licence", ["all rights reserved"]), ("absent", ["zzqzz"])], "topic string, terms array<string>")
    return evidence.coverage(e, topics).withColumnRenamed("level", "level_")


@query(
    """with t(topic, terms, priority) as (values ('stop', ['that'], 'high'), ('absent', ['zzqzz'], 'low'), ('missing', ['qqzqq', 'zxzxz'], 'high'))
    select topic, priority, case priority when 'high' then 0 when 'medium' then 1 else 2 end urgency, row_number() over (order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, topic) place from t where not exists (select 1 from documents where len(list_filter(terms, lambda k: contains(lower(text), k))) > 0)"""
)
def research_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K.table(spark, sf_dir, "documents").select(F.col("text").alias("snippet"))
    topics = spark.createDataFrame([("stop", ["that"], "high"), ("absent", ["zzqzz"], "low"), ("missing", ["qqzqq", "zxzxz"], "high")], "topic string, terms array<string>, priority string")
    return evidence.gaps(e, topics)


#: chunks as documents: selected by score, priority by class, items counted from labels
_CHUNKS = f"""(select d.doc_id, d.source, text, score >= 0.35 selected, case when length(text) < 150 then 'skip' else 'medium' end priority, relevance, coalesce(quality_, 0) items from documents d join ({_RETRIEVED}) r on d.doc_id = r.doc_id
    left join (select doc_id, quality quality_ from labels) l on d.doc_id = l.doc_id)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.table(spark, sf_dir, "documents").select("doc_id", "text")
    r = _scored(spark, sf_dir).select("doc_id", "source", "score", "relevance")
    items = K.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("items"))
    c = d.join(r, "doc_id").join(items, "doc_id", "left")
    return c.select("doc_id", "source", "text", (F.col("score") >= 0.35).alias("selected"), F.when(F.length("text") < 150, "skip").otherwise("medium").alias("priority"), "relevance", F.coalesce("items", F.lit(0)).alias("items"))


@query(
    f"""select doc_id, case when not selected then 'not_sent' when items > 0 then 'accepted' else 'rejected' end decision, case when selected and items > 0 then null when selected then 'no evidence extracted' when priority = 'skip' then 'skipped'
    when relevance = 0 then 'not relevant to question' else 'excluded by character budget' end reason from {_CHUNKS}"""
)
def chunk_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.chunk_decisions(_chunks(spark, sf_dir)).select("doc_id", "decision", "reason")


_CATEGORY_SQL = f"case when category in ({', '.join(map(K.quoted, L.CATEGORIES))}) then category else coalesce(case category {' '.join(f'when {K.quoted(k)} then {K.quoted(v)}' for k, v in L.CATEGORY_ALIASES.items())} end, 'other') end"
_TOPIC_ORDER = " ".join(f"when {K.quoted(n)} then {i}" for i, (n, _) in enumerate(_TOPICS))
_SHOWN = "regexp_replace(regexp_replace(snippet, '\\s+', ' ', 'g'), '^ +| +$', '', 'g')"
_LISTED = f"list_filter([{', '.join(f'case when contains(lower(snippet), {K.quoted(t)}) then {K.quoted(t)} end' for t in sorted(_TERMS))}], lambda x: x is not null)"
_EXTRACTED_SQL = f"""{_TOPIC_SQL}, {_FALLBACK_SQL}, have as (select doc_id, count(*) n from ts group by doc_id),
    rows as (select doc_id, case topic {_TOPIC_ORDER} end a, n b, topic category, snippet from ts
      union all select f.doc_id, {len(_TOPICS)}, f.n, {K.sql_first_terms("snippet", L.CATEGORY_LADDER, "other")}, snippet from fallback f left join have h on f.doc_id = h.doc_id where coalesce(h.n, 0) < 4),
    firsts as (select * from (select *, row_number() over (partition by doc_id, category, snippet order by a, b) d from rows) where d = 1),
    capped as (select * from (select *, row_number() over (partition by doc_id order by a, b) as ord from firsts) where ord <= 20),
    said as (select doc_id, ord, {_CATEGORY_SQL} category, snippet, upper(substr(category, 1, 1)) || lower(substr(category, 2)) || ' note: ' || case when length({_SHOWN}) > 180 then rtrim(substr({_SHOWN}, 1, 177)) || '...' else {_SHOWN} end claim,
      case when len({_LISTED}) > 0 then 'Directly relevant to the question through these terms: ' || array_to_string({_LISTED}[1:5], ', ') || '.' else 'Indirect context; review against stronger source evidence before relying on it.' end relevance,
      case when {K.sql_hits("snippet", _TERMS)} >= 3 and length(snippet) >= 80 then 'high' when {K.sql_hits("snippet", _TERMS)} >= 1 and length(snippet) >= 60 then 'medium' else 'low' end confidence from capped),
    kept as (select s.*, d.source, {_QUALITY} quality from said s join documents d on s.doc_id = d.doc_id where not regexp_matches({_ASCII.format(x="claim")}, {K.quoted(L.CROSS_COMPARISON)})),
    both_ as (select *, lower(claim || ' ' || snippet || ' ' || category || ' ' || relevance) hay, lower({_ASCII.format(x="claim || ' ' || snippet")}) low from kept),
    sc as (select *, {K.sql_hits("hay", _TERMS)} hits, {K.sql_count("low", L.SPECIFIC_NUMBER)} num, {K.sql_hits("low", L.SPECIFIC_TERMS)} spec, {K.sql_count("low", L.UNIT_NUMBER)} units, {K.sql_count("low", L.BARE_NUMBER)} bare from both_),
    scored as (select *, case when hits >= 4 or (category = 'power' and hits >= 2) then 5 when hits >= 2 or category = 'power' then 4 when hits = 1 or category <> 'other' then 3 when {K.sql_any("hay", L.DOMAIN_TERMS)} then 2 else 1 end relevance_score,
      case when num >= 2 or spec >= 5 then 5 when num >= 1 or spec >= 3 then 4 when spec >= 1 or length(snippet) >= 140 then 3 when length(snippet) >= 60 then 2 else 1 end specificity_score,
      case when units >= 3 then 5 when units >= 2 then 4 when units >= 1 or bare >= 3 then 3 when bare >= 1 then 2 else 1 end quantitative_score from sc),
    overall as (select *, round(0.40 * relevance_score::double + 0.22 * quality::double + 0.25 * specificity_score::double + 0.13 * quantitative_score::double, 2) overall_score from scored)"""


def _extracted(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None, least: float | None = None) -> DataFrame:
    d = (K.table(spark, sf_dir, "documents") if documents is None else documents).select("doc_id", "text", "source", (1 + F.substring("source", 4, 9).cast("int") % 5).alias("quality"))
    may = None if least is None else evidence.may_score(_TERMS, ("power",), least)
    e = evidence.scored(evidence.extracted(d, _TERMS, _TOPICS, keep=("source", "quality"), may_score=may), _TERMS, ("power",), least=least)
    return evidence.sanitised(e)[0]


@query(
    f"""with {_EXTRACTED_SQL.removeprefix("with ")} select doc_id, ord, category, md5(snippet) snippet, md5(claim) claim, relevance, confidence, source, quality, relevance_score, specificity_score, quantitative_score, overall_score,
    {K.sql_first_pattern(_ASCII.format(x="claim"), L.EVIDENCE_TYPES, "fact")} evidence_type, {K.sql_densest("claim", L.PERSPECTIVES_AI_DC, "general")} perspective from overall"""
)
def deterministic_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole extraction: topic sentences, fallback, caps, texts, scores, enrichment."""
    e = evidence.enriched(_extracted(spark, sf_dir)).drop("topics")
    return e.withColumns({"snippet": F.md5(F.col("snippet").cast("binary")), "claim": F.md5(F.col("claim").cast("binary"))})


@query(
    f"""with {_EXTRACTED_SQL.removeprefix("with ")}, r as (select doc_id, ord, overall_score, row_number() over (order by overall_score desc, relevance_score desc, specificity_score desc, lower(source), doc_id, ord) rank from overall)
    select doc_id, ord, overall_score, rank, 'E' || lpad(rank::varchar, 3, '0') evidence_id from r where rank <= 100"""
)
def ranked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pieces of evidence, numbered by rank."""
    order = [F.desc("overall_score"), F.desc("relevance_score"), F.desc("specificity_score"), F.lower("source"), "doc_id", "ord"]
    r = select.ranked_top(_extracted(spark, sf_dir), order, 100)
    return r.select("doc_id", "ord", "overall_score", "rank", T.numbered("E", F.col("rank")).alias("evidence_id"))


@query(
    f"""with b as (select doc_id, source, substr(sha256(lower({_COMPACT})), 1, 16) f from documents), stored as (select f from b where source < 'src15'), n as (select *, row_number() over (partition by f order by doc_id) rn from b where source >= 'src15')
    select doc_id, f fingerprint from n where rn = 1 and f not in (select f from stored)"""
)
def new_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store holds some sources; the others come in."""
    d = K.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("statement"))
    stored = d.filter("source < 'src15'").select(T.fingerprint(F.col("statement")).alias("fingerprint"))
    return evidence.new_statements(d.filter("source >= 'src15'"), stored, order="doc_id").select("doc_id", "fingerprint")


@query(f"select source, count(*) n, sum({K.sql_hits('text', _TERMS)})::bigint hits, count(*) filter (where {K.sql_any('text', ('license', 'rights'))}) licensed from documents group by source")
def keyword_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return K.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(R.term_hits(t, _TERMS)).alias("hits"), F.count_if(R.any_term(t, ("license", "rights"))).alias("licensed"))


@query(f"with {_EXTRACTED_SQL.removeprefix('with ')} select md5(claim) claim, category, md5(snippet) supporting_quote, source, confidence, overall_score candidate_score, quality source_quality_score from overall")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence before ranking, as a pool of candidates."""
    c = evidence.candidate_pool(_extracted(spark, sf_dir))
    digest = lambda x: F.md5(F.col(x).cast("binary")).alias(x)
    return c.select(digest("claim"), "category", digest("supporting_quote"), "source", "confidence", "candidate_score", "source_quality_score")
