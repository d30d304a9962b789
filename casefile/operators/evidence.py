"""An evidence ledger that is kept up by batches, and the evidence behind an edge.

The ledger holds each evidence record of an edge once, in buckets of edges; edges are a table of their own in the same
buckets. A batch is joined with the ledger of the buckets that it touches, what is new is appended, and the edges of those
buckets alone are counted anew. Records are appended before edges are written, and a bucket whose edges do not count all of
its records is counted again, so a batch that failed half way is made whole by its repetition, and a repeated batch writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.operators.graph import BANK_MODULES, TRAIL_MODULES, total
from casefile.session import Work

KEYS = ("src", "dst", "relation", "module")
RECORD = ("evidence_id", "weight", "confidence", "batch")
LEDGER = "src long, dst long, relation string, module string, evidence_id string, weight double, confidence double, batch string, bucket int"
EDGES = "src long, dst long, relation string, module string, weight double, confidence double, evidence long, bucket int"

# What kind of evidence an edge shows, by module and relation.
DOCUMENT_MODULES, DOCUMENT_RELATIONS, VOICE_MODULE, CHAT_MODULE = ("q_verify", "q_scan"), ("PARTNER", "MENTIONED_IN"), "q_voice", "q_chat"


def table_at(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty before its first write."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def counted(ledger: DataFrame) -> DataFrame:
    """Edges of a ledger: weights of the records added up, the best confidence, the number of records."""
    return ledger.groupBy(*KEYS, "bucket").agg(total("weight").alias("weight"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("evidence")).select(*KEYS, "weight", "confidence", "evidence", "bucket")


def synchronise(spark: SparkSession, folder: str, findings: DataFrame, batch: str, buckets: int = 64) -> dict[str, int]:
    """Take findings (src, dst, relation, module, evidence_id, weight, confidence) into the ledger in ``folder``; how many records were new and how many buckets were counted.

    A record counts once for an edge of one module, however often it comes; of equal ones in a batch the largest weight and
    confidence. Rows without an end or an evidence_id are left out. ``buckets`` is the same in every call.
    """
    ledger_path, edges_path = f"{folder}/ledger", f"{folder}/edges"
    with Work(spark) as work:
        good = findings.filter("src is not null and dst is not null and evidence_id is not null")
        once = good.groupBy(*KEYS, "evidence_id").agg(F.max("weight").alias("weight"), F.max("confidence").alias("confidence"))
        pair = F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"))
        once = once.withColumn("bucket", F.pmod(pair, F.lit(buckets)).cast("int")).withColumn("batch", F.lit(batch))
        once = work.written(once.select(*KEYS, *RECORD, "bucket"), "ledger-batch")
        touched = [r[0] for r in once.select("bucket").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return {"records": 0, "buckets": 0}
        held = table_at(spark, ledger_path, LEDGER).filter(F.col("bucket").isin(touched))
        names = (*KEYS, "evidence_id")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("bucket", *names)]
        new = work.written(once.alias("n").join(held.select("bucket", *names).alias("h"), same, "left_anti"), "ledger-new")
        records = new.count()
        if records:
            new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(ledger_path)
        held = table_at(spark, ledger_path, LEDGER).filter(F.col("bucket").isin(touched)).groupBy("bucket").agg(F.count(F.lit(1)).alias("records"))
        shown = table_at(spark, edges_path, EDGES).filter(F.col("bucket").isin(touched)).groupBy(F.col("bucket").alias("e_bucket")).agg(F.sum("evidence").alias("shown"))
        stale = [r[0] for r in held.join(shown, F.col("bucket") == F.col("e_bucket"), "left").filter("shown is null or shown <> records").select("bucket").collect()]
        if stale:
            edges = counted(table_at(spark, ledger_path, LEDGER).filter(F.col("bucket").isin(stale))).repartition("bucket")
            edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(edges_path)
        return {"records": records, "buckets": len(stale)}


def ledger_of(spark: SparkSession, folder: str) -> DataFrame:
    return table_at(spark, f"{folder}/ledger", LEDGER)


def edges_of(spark: SparkSession, folder: str) -> DataFrame:
    return table_at(spark, f"{folder}/edges", EDGES)


def edges_meant(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """(link, edge_id): the edges that each link (link, a string) of a drawing stands for.

    A link is a list of edge ids between commas, or of the form kind__src__dst or kind__src__dst__keyword for all edges between two nodes in
    either direction. Links that stand for nothing have no row.
    """
    parts = F.split("link", "__")
    listed = wanted.filter(~F.contains("link", F.lit("__"))).select("link", F.explode(F.array_distinct(F.transform(F.split("link", ","), lambda x: F.trim(x).try_cast("long")))).alias("edge_id")).filter("edge_id is not null")
    listed = listed.join(edges.select("edge_id"), "edge_id", "left_semi").select("link", "edge_id")
    made = wanted.filter(F.contains("link", F.lit("__"))).select("link", F.try_element_at(parts, F.lit(2)).try_cast("long").alias("x"), F.try_element_at(parts, F.lit(3)).try_cast("long").alias("y"))
    ends = edges.select("edge_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    met = made.join(ends, (F.least("x", "y") == F.col("a")) & (F.greatest("x", "y") == F.col("b")) & F.col("x").isNotNull() & F.col("y").isNotNull())
    return listed.unionByName(met.select("link", "edge_id")).distinct()


def evidence_of(wanted: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """link, evidence_id, edge_id, category, module, summary, amount: the records behind each link of a drawing.

    edges: edge_id, src, dst, relation, module, weight; evidence: evidence_id, edge_id, module, summary, amount. A record counts once for a
    link, by its first edge; without an amount it shows its edge's weight. The category is that of the link's first edge: DOCUMENT, VOICE, CHAT or FINANCIAL.
    """
    meant = edges_meant(wanted, edges)
    about = edges.select("edge_id", F.lower(F.coalesce("module", F.lit(""))).alias("edge_module"), F.coalesce("relation", F.lit("")).alias("relation"), "weight")
    module, relation = F.col("c.edge_module"), F.col("c.relation")
    category = (
        F.when(module.isin(*DOCUMENT_MODULES) | relation.isin(*DOCUMENT_RELATIONS), "DOCUMENT").when((module == VOICE_MODULE) | F.contains(relation, F.lit("VOICE")), "VOICE")
        .when(module == CHAT_MODULE, "CHAT").otherwise("FINANCIAL")
    )
    shown = meant.join(about, "edge_id")
    first = shown.groupBy("link").agg(F.min_by(F.struct("edge_module", "relation"), "edge_id").alias("c")).select("link", category.alias("category"))
    records = evidence.select("evidence_id", "edge_id", "module", "summary", "amount")
    each = shown.join(records, "edge_id").groupBy("link", "evidence_id").agg(F.min_by(F.struct("edge_id", "module", "summary", F.coalesce("amount", "weight").alias("amount")), "edge_id").alias("r"))
    return each.join(first, "link").select("link", "evidence_id", "r.edge_id", "category", "r.module", "r.summary", "r.amount")


def link_totals(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """link, links, weight: edges behind each link, and their weight: that of bank and ledger or of the trail, whichever is more, else the sum of all."""
    shown = edges_meant(wanted, edges).join(edges.select("edge_id", F.lower(F.coalesce("module", F.lit(""))).alias("m"), "weight"), "edge_id")
    bank, trail = F.col("m").isin(*BANK_MODULES), F.col("m").isin(*TRAIL_MODULES)
    zero = F.lit(0.0)
    part = lambda test: F.coalesce(total(F.when(test, F.col("weight"))), zero)
    out = shown.groupBy("link").agg(F.count(F.lit(1)).alias("links"), part(bank).alias("_b"), part(trail).alias("_t"), part(~bank & ~trail).alias("_o"))
    weight = F.when((F.col("_b") > 0) & (F.col("_t") > 0), F.greatest("_b", "_t")).when((F.col("_b") > 0) | (F.col("_t") > 0), F.col("_b") + F.col("_t")).otherwise(F.col("_b") + F.col("_t") + F.col("_o"))
    return out.select("link", "links", weight.alias("weight"))
