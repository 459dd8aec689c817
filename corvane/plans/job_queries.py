"""The jobs as queries: each runs twice into a new folder, and its whole output is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.functions import html as H
from corvane.functions import lexicon as L
from corvane.plans import carriers as K
from corvane.plans import document_queries as D
from corvane.plans.catalog import query
from corvane.sources.scratch import shared_dir
from jobs import evidence_feed, page_corpus


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one call; it is left in place."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_SOURCE_QUALITY = D._quality_sql(1).replace("(name)", "(d.source)")
_FINGERPRINT = f"substr(sha256(lower({K.COMPACT_SQL.format(x='claim')})), 1, 16)"


@query(
    f"""with {D._EXTRACTED_SQL.removeprefix("with ").replace(f"{D._QUALITY} quality", f"{_SOURCE_QUALITY} quality")}
    select doc_id, source, ord, claim, snippet, {_FINGERPRINT} fingerprint, relevance, confidence, quality, relevance_score, specificity_score, quantitative_score, overall_score,
    {K.sql_first_pattern(D._ASCII.format(x="claim"), L.EVIDENCE_TYPES, "fact")} evidence_type, {K.sql_densest("claim", L.PERSPECTIVES_AI_DC, "general")} perspective, category from overall"""
)
def job1_evidence_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, config = folder(spark, "job1-evidence-feed"), evidence_feed.load_config()
    for _ in range(2):  # the table may be a folder or one file; a stream takes the latter as a pattern only
        evidence_feed.run(spark, f"{sf_dir}/documents.parque[t]", f"{at}/evidence", f"{at}/checkpoint", config)
    return evidence_feed.output(spark, f"{at}/evidence")


def _marked_sql(x: str) -> str:
    for pattern, by in H.STEPS:
        x = f"regexp_replace({x}, {K.quoted(pattern)}, {K.quoted(by)}, 'g')"
    for entity, char in H.ENTITIES:
        x = f"replace({x}, {K.quoted(entity)}, {K.quoted(char)})"
    return x


#: pages with their main text: of all runs of blocks the one with the greatest sum
MAIN_TEXT_SQL = rf"""m as (select page_id, url, html, string_split({_marked_sql("html")}, chr(1)) a from pages),
    b0 as (select page_id, unnest(a) b, generate_subscripts(a, 1) i from m),
    b1 as (select *, {K.COMPACT_SQL.format(x="regexp_replace(b, '[' || chr(2) || '-' || chr(4) || ']', '', 'g')")} t,
      len(regexp_extract_all(array_to_string(regexp_extract_all(b, chr(2) || '([^' || chr(3) || ']*)', 1), ' '), '\S+')) linked from b0),
    b2 as (select *, len(regexp_extract_all(t, '\S+')) w, row_number() over (partition by page_id order by i) k from b1 where t <> ''),
    b3 as (select *, case when contains(b, chr(4)) then 0 else w - {H.LEAST} end - 2 * linked p from b2),
    b4 as (select *, sum(p) over (partition by page_id order by k) upto from b3),
    runs as (select x.page_id, x.k f, y.k l, y.upto - x.upto + x.p total from b4 x join b4 y on x.page_id = y.page_id and x.k <= y.k),
    best as (select page_id, f, l from (select *, row_number() over (partition by page_id order by total desc, l, f) rn from runs where total > 0) where rn = 1),
    main as (select m.page_id, m.url, m.html, coalesce(string_agg(t, chr(10) order by k) filter (where case when best.f is null then 2 * linked < w else k between best.f and best.l end), '') text
      from m left join b4 on m.page_id = b4.page_id left join best on m.page_id = best.page_id group by m.page_id, m.url, m.html)"""


def _chunked_sql(source: str, target: int, most: int) -> str:
    """Chunks c (page_id, start_offset, end_offset, chunk_number) of a table with page_id and text."""
    first, last = f"list_min(list_filter(ends, lambda x: x >= {{at}} + {target} and x < {{at}} + {most}))", f"list_max(list_filter(ends, lambda x: x > {{at}} and x < {{at}} + {most}))"
    cut = f"case when {{at}} + {most} >= n then n else coalesce({first}, {last}, {{at}} + {most}) end"
    return rf"""pieces as (select page_id, length(text) n, string_split(regexp_replace(text, '([.!?])([ \t\n\x0b\f\r])', '\1' || chr(1) || '\2', 'g'), chr(1)) p from {source}),
    ends as (select page_id, n, list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::bigint) ends from pieces),
    c as (select page_id, n, ends, 1 chunk_number, 0::bigint start_offset, ({cut.format(at=0)})::bigint end_offset from ends
      union all select page_id, n, ends, chunk_number + 1, end_offset, ({cut.format(at="end_offset")})::bigint from c where end_offset < n)"""


@query(
    rf"""with recursive {MAIN_TEXT_SQL},
    clean as (select *, substr(sha256(lower({K.COMPACT_SQL.format(x="text")})), 1, 16) fp from main where length(text) >= {page_corpus.load_config()["least_chars"]}),
    kept as (select * from (select *, row_number() over (partition by fp order by page_id, url) rn from clean) where rn = 1),
    {_chunked_sql("kept", page_corpus.load_config()["target_chars"], page_corpus.load_config()["most_chars"])}
    select k.page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) host, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)) title, chunk_number, start_offset, end_offset,
      substr(text, start_offset + 1, end_offset - start_offset) chunk_text, case when regexp_extract(html, '(?i)<html\b[^>]*\blang=["'']?([A-Za-z]+)', 1) = '' then 'und' else lower(regexp_extract(html, '(?i)<html\b[^>]*\blang=["'']?([A-Za-z]+)', 1)) end lang
    from c join kept k on c.page_id = k.page_id"""
)
def job2_page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, config = folder(spark, "job2-page-corpus"), page_corpus.load_config()
    for _ in range(2):
        page_corpus.run(spark, f"{sf_dir}/pages.parquet", at, config)
    return page_corpus.output(spark, at)
