"""Evidence store: Parquet tables under one root, partitioned by domain, appended by Spark's commit protocol.

A source is known by the hash of its text.  A build skips sources that the manifest already has and keeps the first of
equal statements.  The manifest is a log of versions, of which the last of a location and of a source counts: nothing is
rewritten or deleted, so a build that breaks off leaves all tables readable.  Every step adds only what is not stored
yet and the manifest comes last, so a repeated build completes what a broken one began.  Evidence of a replaced source
stays; ``live`` leaves it out, and ``compacted`` builds a store without it beside this one, which readers can keep.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import evidence as E
from corvane.operators import plugin, select

TABLES = {
    "source": "source_id string, uri string, text string, domain string",
    "evidence": "evidence_id string, statement string, fingerprint string, source_id string, category string, domain string",
    "metadata": "evidence_id string, enabled boolean, priority int, value double, overall double, version int, domain string",
    "run": "run_id string, status string, ordinal bigint, domain string",
    "contradiction": "contradiction_id string, a string, b string, reason string, domain string",
    "manifest": "source_id string, uri string, evidence_count bigint, version bigint, domain string",
    "embedding": "evidence_id string, vector array<float>, domain string",
}


@dataclass
class Store:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str, domain: str | None = None) -> DataFrame:
        """A table; with a domain only its partition is listed and read."""
        if not self.exists(name):
            return self.spark.createDataFrame([], TABLES[name])
        t = self.spark.read.schema(TABLES[name]).parquet(self.path(name))
        return t.filter(F.col("domain") == domain) if domain else t

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [f.name for f in self.spark.createDataFrame([], TABLES[name]).schema.fields]
        rows.select(*columns).write.mode("append").partitionBy("domain").parquet(self.path(name))

    def domains(self) -> DataFrame:
        return self.read("source").select("domain").distinct()

    def metadata(self) -> DataFrame:
        """Records, the last version of each."""
        return select.latest(self.read("metadata"), "evidence_id", "version")

    def runs(self) -> DataFrame:
        """Runs, the last state of each."""
        return select.latest(self.read("run"), "run_id", "ordinal")

    def evidence(self, evidence_id: str) -> DataFrame:
        return self.read("evidence").filter(F.col("evidence_id") == evidence_id)

    def manifest(self, domain: str | None = None) -> DataFrame:
        """Rows in force: in each domain the last of every location, and of every source."""
        m = self.read("manifest", domain)
        for name in ("uri", "source_id"):
            m = select.latest(m.withColumn("__k", F.struct("domain", name)), "__k", "version").drop("__k")
        return m

    def _staged(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows written under the root and read back: appends to the tables they came from cannot change them."""
        path = self.path(f".staging/{name}")
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _drop_staged(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(".staging"))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def build(self, documents: DataFrame, domain: str, run_id: str, embed: Callable | None = None) -> dict[str, int]:
        """One incremental build from documents (uri, text): counts of what came, was skipped, and was added.

        Of equal texts the one at the least location counts.  embed, if given, makes an embedder in each worker (see
        plugin.embeddings); statements without a vector are left out."""
        ordinal = self.read("run").count()
        state = lambda s, o: self.spark.createDataFrame([(run_id, s, o, domain)], TABLES["run"])
        self.append("run", state("RUNNING", ordinal))
        docs = select.deduplicated(documents.withColumn("source_id", X.source_id(F.col("text"))), ["source_id"], ["uri"])
        new = docs.join(self.manifest(domain).select("source_id"), "source_id", "left_anti")
        new = self._staged(new, f"{run_id}-source")
        came, added = docs.count(), new.count()
        facts = 0
        if added:
            said = E.extracted(new.select("source_id", "text"), (), key="source_id").select("source_id", "ord", "category", F.col("snippet").alias("statement"))
            keyed = said.withColumn("__o", F.concat_ws("-", "source_id", F.lpad(F.col("ord").cast("string"), 6, "0")))
            fresh = E.new_statements(keyed, self.read("evidence", domain), order="__o")
            fresh = fresh.withColumns({"evidence_id": F.substring(F.sha2(F.concat_ws("|", F.lit(domain), "fingerprint"), 256), 1, 32), "domain": F.lit(domain)})
            fresh = self._staged(fresh, f"{run_id}-evidence")
            facts = fresh.count()
            self.append("source", self._staged(new.join(self.read("source", domain).select("source_id"), "source_id", "left_anti").withColumn("domain", F.lit(domain)), f"{run_id}-sources"))
            self.append("evidence", fresh)
            held = self.read("evidence", domain).join(new.select("source_id"), "source_id", "left_semi")
            bare = held.join(self.read("metadata", domain).select("evidence_id"), "evidence_id", "left_anti")
            record = bare.withColumns({"confidence": F.lit("medium"), "quality": F.lit(3), "relevance_score": F.lit(3), "specificity_score": F.lit(3), "claim": F.col("statement")})
            record = E.store_metadata(record).select("evidence_id", F.col("defaults.enabled").alias("enabled"), F.col("defaults.priority").alias("priority"), F.col("defaults.value").alias("value"), "overall", F.lit(1).alias("version"), "domain")
            self.append("metadata", self._staged(record, f"{run_id}-metadata"))
            if embed is not None:
                self.embed(domain, embed)
            counts = held.groupBy("source_id").agg(F.count("*").alias("evidence_count"))
            rows = new.select("source_id", "uri").join(counts, "source_id", "left")
            self.append("manifest", rows.select("source_id", "uri", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), F.lit(ordinal).cast("long").alias("version"), F.lit(domain).alias("domain")))
        self._drop_staged()
        self.append("run", state("COMPLETED", ordinal + 1))
        return {"documents": came, "skipped": came - added, "added": added, "evidence": facts}

    def embed(self, domain: str, make: Callable) -> None:
        """Vectors for the evidence that has none yet; statements that get none are skipped."""
        made = plugin.embeddings(self.read("evidence", domain).select("evidence_id", "statement"), self.read("embedding", domain).select("evidence_id", "vector"), make)
        rows = made.filter("vector is not null").withColumn("domain", F.lit(domain))
        self.append("embedding", self._staged(rows, f"embedding-{domain}"))

    def live(self, name: str, domain: str | None = None) -> DataFrame:
        """Rows of source, evidence, metadata or embedding that belong to sources in force, records in their last version."""
        rows = self.metadata() if name == "metadata" else self.read(name, domain)
        rows = rows.filter(F.col("domain") == domain) if domain and name == "metadata" else rows
        sources, key = self.manifest(domain).select("domain", "source_id").distinct(), ["domain", "source_id"]
        if name in ("source", "evidence"):
            return rows.join(sources, key, "left_semi")
        return rows.join(self.read("evidence", domain).join(sources, key, "left_semi").select("evidence_id"), "evidence_id", "left_semi")

    def compacted(self, root: str, run_id: str = "compacted") -> Store:
        """A store at another root, built from the sources in force.

        Statements that a replaced source said first are found again at the sources that still say them; evidence keeps its
        ids, and vectors are carried over.  A broken build is completed by calling it again."""
        other = Store(self.spark, root)
        for (domain,) in self.domains().orderBy("domain").collect():  # domains are a vocabulary
            held = self.manifest(domain).select("source_id", "uri").join(self.read("source", domain).select("source_id", "text"), "source_id")
            other.build(held.select("uri", "text"), domain, f"{run_id}-{domain}")
            vectors = self.read("embedding", domain).join(other.read("evidence", domain).select("evidence_id"), "evidence_id", "left_semi")
            other.append("embedding", vectors.join(other.read("embedding", domain).select("evidence_id"), "evidence_id", "left_anti").dropDuplicates(["evidence_id"]))
        return other

    def report(self) -> DataFrame:
        """Per domain: sources in force, their evidence, runs, and the share of runs that completed."""
        m = self.manifest().groupBy("domain").agg(F.count("*").alias("sources"), F.sum("evidence_count").alias("evidence"))
        r = self.runs().groupBy("domain").agg(F.count("*").alias("runs"), F.round(F.avg((F.col("status") == "COMPLETED").cast("int")), 4).alias("completed"))
        return m.join(r, "domain", "full_outer")

    def issues(self) -> DataFrame:
        """(domain, issue) of what keeps a domain from being read: no evidence, no records, counts that differ by 5 % or more."""
        h = self.health()
        e, m = F.col("evidence"), F.col("metadata")
        found = F.array(
            F.when(e == 0, "no evidence"),
            F.when((e > 0) & (m == 0), "no records"),
            F.when((e > 0) & (m > 0) & (F.abs(e - m) / F.greatest(e, m) >= 0.05), "evidence and records differ"),
        )
        return h.select("domain", F.explode(F.array_compact(found)).alias("issue"))

    def sources_of(self, domain: str | None = None) -> DataFrame:
        """(domain, uri, source_id, evidence_count) of the sources in force, by domain and location."""
        return self.manifest(domain).select("domain", "uri", "source_id", "evidence_count").orderBy("domain", "uri")

    def health(self) -> DataFrame:
        """Per domain: sources, evidence, records, whether records and evidence agree within 5 %, readiness."""
        n = lambda name: self.read(name).groupBy("domain").agg(F.count("*").alias(name))
        h = n("source").join(n("evidence"), "domain", "full_outer").join(n("metadata"), "domain", "full_outer").fillna(0)
        even = F.abs(F.col("evidence") - F.col("metadata")) <= 0.05 * F.greatest("evidence", F.lit(1))
        return h.withColumns({"consistent": even, "ready": even & (F.col("evidence") > 0)})

    def missing_embeddings(self) -> DataFrame:
        return self.read("evidence").join(self.read("embedding").select("evidence_id"), "evidence_id", "left_anti")
