"""Inputs for queries, drawn from the driver's tables, in both dialects.

The prose of the corpus is invented, so claims are rendered from parts: one of TEMPLATES per part, filled with
its brand, its size and ten more than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.scratch import spread

TEMPLATES = (
    "Rack power for {b} is {v} kW today at the facility.",
    "The {b} rack is expected to reach {v} kW by 2032 under the roadmap.",
    "A {b} power shelf supplies {v} kW per shelf.",
    "{b} draws {v} kW, which is more than legacy racks with {w} kW.",
    "Construction of the {b} reactor takes {v}-{w} months because licensing delays work.",
    "Licensing review of {b} lasts {v} months and must be approved.",
    "The {b} cluster uses air cooling with {v} GPUs in each rack.",
    "The {b} cluster uses liquid cooling with {v} GPUs in each rack.",
    "For example, a sample deployment of {b} needs {v} MW.",
    "Industry average racks draw {v} kW; {b} is limited by supply.",
    "NVIDIA rates {b} at {v} kW per rack in its data sheet.",
    "{b} densities above {v} kW are a risk and a challenge for facilities.",
    "{b} becomes operational in 2029 with commercial operation at {v} MW.",
    "{b} becomes operational in 2030 with commercial operation at {v} MW.",
    "In contrast to other sources, {b} claims {v} percent efficiency.",
    "{b} ranges from {v}-{w} kW across the campus.",
    "The regulator published its annual report on {b} in March 2024.",
    "NERC and FERC Order 2023 require an interconnection agreement for {b}.",
    "{b} cost is {v} million USD per unit, compared to {w} million.",
    "No safety concern was found for {b}.",
    "{b} eliminates the {v} kW legacy limit.",
    "Is {b} limited to {v} kW?",
    "Reactor Alpha of {b} delivers {v} MW per year as a capacity target.",
    "The document number of {b} is on file; all rights reserved.",
    "The GB200 NVL72 rack draws {v} kW and holds {w} GPU trays.",
    "The NVL72 draws {w} kW at full load.",
    "The NVL36 rack of {b} draws {v} kW.",
    "An H100 system uses {v} GPU modules at {w} °C.",
    "A Blackwell B200 system uses {w} GPU modules at {v} °C.",
    "The Rubin platform of {b} reaches {v} TB and {w} GB of memory.",
    "Each node draws {v} W, {w} x the old figure.",
    "The plant of {b} has {v} GW; its twin has {w} rack rows.",
    "A single-phase loop serves {b}; 72 GPU trays stay below {v} °C.",
    "A two-phase loop serves {b}; 144 GPU trays stay below {w} °C.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name == "documents" else read


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, claim, brand, size)."""
    p = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    t = F.get(F.array(*map(F.lit, TEMPLATES)), (F.col("id") % len(TEMPLATES)).cast("int"))
    for mark, value in (("{b}", F.col("brand")), ("{v}", F.col("size").cast("string")), ("{w}", (F.col("size") + 10).cast("string"))):
        t = F.replace(t, F.lit(mark), value)
    return p.withColumn("claim", t)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CLAIMS_SQL = f"""(select p_partkey id, p_brand brand, p_size size, replace(replace(replace([{", ".join(map(quoted, TEMPLATES))}][p_partkey % {len(TEMPLATES)} + 1],
  '{{b}}', p_brand), '{{v}}', p_size::varchar), '{{w}}', (p_size + 10)::varchar) claim from part)"""


def sql_first_pattern(x: str, rules: tuple, default: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, {quoted(p)}) then {quoted(label)}" for label, p in rules) + f" else {quoted(default)} end"


def sql_any(x: str, terms: tuple) -> str:
    return "(" + " or ".join(f"contains(lower({x}), {quoted(t.lower())})" for t in terms) + ")"


def sql_hits(x: str, terms: tuple) -> str:
    return "(" + " + ".join(f"contains(lower({x}), {quoted(t.lower())})::int" for t in terms) + ")"


def sql_pattern_hits(x: str, patterns: tuple) -> str:
    return "(" + " + ".join(f"regexp_matches({x}, {quoted(p)})::int" for p in patterns) + ")"


def sql_first_terms(x: str, rules: tuple, default: str) -> str:
    return "case " + " ".join(f"when {sql_any(x, terms)} then {quoted(label)}" for label, terms in rules) + f" else {quoted(default)} end"


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))"


def sql_densest(x: str, groups: tuple, default: str) -> str:
    """Label with most terms, the first of equals."""
    best = f"greatest({', '.join(sql_hits(x, t) for _, t in groups)})"
    return f"case when {best} = 0 then {quoted(default)} " + " ".join(f"when {sql_hits(x, t)} = {best} then {quoted(label)}" for label, t in groups) + " end"


SENTENCES_SQL = r"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
COMPACT_SQL = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
