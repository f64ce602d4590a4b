"""Project memory: fact tables on disk, and their reconciliation batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import facts

#: Columns of a fact.
FACT = "fact_id string, status string, claim string, snapshot string, paragraph string, signature string, evidence_ids array<string>, stale boolean, reason string"
STATUSES = ("OBSERVED", "INFERRED", "VERIFIED", "REJECTED")
MAX_FACTS, MAX_BYTES = 10_000, 10 << 20


def create(claims: DataFrame) -> DataFrame:
    """Facts of rows (status, claim, snapshot, paragraph, signature, evidence_ids); the id is a content address.

    An unknown status or an empty claim is an error; VERIFIED needs evidence.
    """
    bad = F.when(~F.col("status").isin(*STATUSES), F.concat(F.lit("status "), "status")).when(F.coalesce(F.trim("claim"), F.lit("")) == "", "empty claim")
    bad = bad.when((F.col("status") == "VERIFIED") & (F.size("evidence_ids") <= 0), "verified without evidence")
    ok = F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("claim"))
    ident = F.concat(F.lit("fact:sha256:"), facts.content_id(F.col("claim"), F.col("snapshot"), F.col("paragraph"), F.col("signature")))
    return claims.select(ident.alias("fact_id"), "status", ok.alias("claim"), "snapshot", "paragraph", "signature", "evidence_ids", F.lit(False).alias("stale"), F.lit(None).cast("string").alias("reason"))


def write(memory: DataFrame, path: str) -> None:
    """One JSON line per fact, at most ``MAX_FACTS`` of ``MAX_BYTES`` together."""
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    size = memory.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).alias("bytes")).first()
    if size.n > MAX_FACTS or size["bytes"] > MAX_BYTES:
        raise ValueError(f"a memory holds {MAX_FACTS} facts of {MAX_BYTES} bytes at most, this one has {size.n} of {size['bytes']}")
    memory.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Facts of JSON lines; blank lines are skipped, other lines that don't parse are errors."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", FACT, {"mode": "FAILFAST"}).alias("f")).select("f.*")


def listed(memory: DataFrame, *, status: str | None = None, stale: bool | None = None, paragraph: str | None = None) -> DataFrame:
    for name, want in (("status", status), ("stale", stale), ("paragraph", paragraph)):
        if want is not None:
            memory = memory.where(F.col(name) == want)
    return memory


def counts(memory: DataFrame) -> DataFrame:
    return memory.agg(F.count("*").alias("facts"), F.count_if(~F.col("stale")).alias("active"), F.count_if("stale").alias("stale"))


def _newest(spark: SparkSession, out_path: str, number: int) -> str | None:
    """The newest finished version before a number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and int(n[1:]) < number and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/{n}/_SUCCESS"))]
    return f"{out_path}/{max(done)}" if done else None


def reconcile_stream(anchors: DataFrame, memory_path: str, out_path: str, checkpoint: str) -> None:
    """Reconcile a memory with a stream of anchors (snapshot, paragraph, signature), one snapshot version per batch.

    Each batch with anchors writes a whole new memory below ``out_path`` from
    the newest one before it; a batch that is run again writes the same folder
    again, and batches without anchors write nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        before = _newest(spark, out_path, number) or memory_path
        snapshot = batch.agg(F.max("snapshot")).first()[0]
        now = facts.reconcile(read(spark, before), batch.where(F.col("snapshot") == snapshot), snapshot)
        now.select(F.to_json(F.struct(*[c.split(" ")[0] for c in FACT.split(", ")]), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{out_path}/v{number:08d}")

    anchors.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
