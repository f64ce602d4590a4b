"""Estates on disk: recursive scan, classification and references of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist")
MAX_BYTES = 5 << 20
#: Words before a table, and words there that are no tables (fixed values).
BEFORE_TABLE = ("FROM", "INTO", "UPDATE")
NO_TABLE = ("SELECT", "SET", "VALUES", "WHERE", "CURSOR", "TABLE", "DUAL")
PROGRAM_ID = r"(?i)PROGRAM-ID\.\s+([A-Za-z0-9_-]+)"


def kind(path: Column, text: Column) -> Column:
    """JCL, COBOL, COPYBOOK or UNKNOWN, by the first rule that holds."""
    up = F.upper(path)
    suffix, folder = F.regexp_extract(up, r"\.([A-Z0-9]+)$", 1), F.regexp_extract(up, r"([^/]+)/[^/]+$", 1)
    division = F.upper(text).rlike(r"(IDENTIFICATION|PROCEDURE|DATA|ENVIRONMENT)\s+DIVISION")
    return (
        F.when(suffix.isin("JCL", "JOB") | (folder == "JCL") | text.rlike(r"(?m)^//[A-Z0-9$#@]+\s+JOB\b"), "JCL")
        .when(text.rlike(PROGRAM_ID), "COBOL")
        .when((suffix.isin("CBL", "COB", "COBOL") | folder.isin("CBL", "COBOL")) & division, "COBOL")
        .when(suffix.isin("CPY", "COPY") | folder.isin("CPY", "COPYBOOK", "COPYBOOKS"), "COPYBOOK")
        .when(text.rlike(r"(?m)^\s*(0[1-9]|[1-4][0-9])\s+[A-Za-z0-9-]+"), "COPYBOOK")
        .otherwise("UNKNOWN")
    )


def sql_tables(code: Column) -> Column:
    """The words after FROM, INTO and UPDATE in embedded SQL, without their schema, in upper case."""
    pieces = F.split(F.upper(code), r"\bEND-EXEC\b")
    closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    sql = F.array_join(F.transform(closed, lambda p: F.coalesce(F.get(F.split(p, r"\bEXEC\s+SQL\b"), F.lit(1)), F.lit(""))), "\n")
    words = F.split(F.trim(F.regexp_replace(sql, r"[^A-Z0-9_.:$#@-]+", " ")), " ")
    named = F.transform(words, lambda w, i: F.when(F.get(words, i - 1).isin(*BEFORE_TABLE), F.regexp_extract(F.substring_index(w, ".", -1), "^[A-Z][A-Z0-9_]*", 0)))
    return F.filter(named, lambda t: t != "")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, lines, kind, detected_id, copybooks, tables, datasets, text) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where((F.col("length") > 0) & (F.col("length") <= MAX_BYTES))
    files = files.where(~F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in EXCLUDED) + ")/"))
    return describe(files.select("path", F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text")))


def describe(rows: DataFrame) -> DataFrame:
    """Kind, id and references of files (path, bytes, text)."""
    code = F.col("text")
    found = lambda p, g=1: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(code, F.lit(p), g), F.upper)))
    tables = sql_tables(code)
    return rows.select(
        "path", "bytes", F.size(F.split(code, "\n")).alias("lines"), kind(F.col("path"), code).alias("kind"),
        F.coalesce(F.nullif(F.upper(F.regexp_extract(code, PROGRAM_ID, 1)), F.lit("")), F.upper(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))).alias("detected_id"),
        found(r"(?im)^\s*(?:\d{6})?\s*COPY\s+[\"']?([A-Za-z0-9_-]+)").alias("copybooks"),
        F.array_sort(F.array_except(F.array_distinct(tables), F.array(*[F.lit(x) for x in NO_TABLE]))).alias("tables"),
        found(r"(?i)\bDSN(?:AME)?=([A-Za-z0-9.$#@&-]+)").alias("datasets"), "text",
    )


def unresolved_copybooks(files: DataFrame) -> DataFrame:
    """(path, copybook) references without a scanned copybook."""
    have = files.where("kind = 'COPYBOOK'").select(F.col("detected_id").alias("copybook"))
    return files.select("path", F.explode("copybooks").alias("copybook")).join(have, "copybook", "left_anti").select("path", "copybook")
