"""Portfolio manifests: the files of an estate in a fixed order, under one checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.facts import two_level_digest

SCHEMA_VERSION = "1.0.0"
ENTRY = ("id", "kind", "path", "sha256")


def entries(files: DataFrame) -> DataFrame:
    """(id, kind, path, sha256) of described files (``scanner.describe``)."""
    return files.select(F.col("detected_id").alias("id"), "kind", "path", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))


def checksum(rows: DataFrame) -> DataFrame:
    """One row (digest, n): over the canonical JSON of the entries, whatever order they come in."""
    return two_level_digest(rows.select(F.to_json(F.struct(*ENTRY), {"ignoreNullFields": "false"}).alias("row")))


def manifest(files: DataFrame) -> DataFrame:
    """One row: schema_version, programs, copybooks, jobs, files, checksum."""
    rows = entries(files)
    counts = rows.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("COBOL", "programs"), ("COPYBOOK", "copybooks"), ("JCL", "jobs"))])
    return counts.join(checksum(rows)).select(F.lit(SCHEMA_VERSION).alias("schema_version"), "programs", "copybooks", "jobs", F.col("n").alias("files"), F.col("digest").alias("checksum"))


def write(files: DataFrame, folder: str) -> None:
    """The entries in order as JSON lines, and the manifest row beside them."""
    entries(files).orderBy("kind", "id", "path").select(F.to_json(F.struct(*ENTRY), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{folder}/entries")
    manifest(files).coalesce(1).write.json(f"{folder}/manifest")


def read(spark, folder: str) -> DataFrame:
    """The entries; another schema version or another checksum than the manifest's is an error."""
    head = spark.read.json(f"{folder}/manifest").first()
    if head.schema_version.split(".")[0] != SCHEMA_VERSION.split(".")[0]:
        raise ValueError(f"manifest of version {head.schema_version}, known is {SCHEMA_VERSION}")
    rows = spark.read.text(f"{folder}/entries").select(F.from_json("value", ", ".join(f"{c} string" for c in ENTRY), {"mode": "FAILFAST"}).alias("e")).select("e.*")
    if checksum(rows).first().digest != head.checksum:
        raise ValueError("the entries don't give the manifest's checksum")
    return rows
