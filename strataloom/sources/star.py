"""Portfolio graphs read from the star-schema tables.

Suppliers play programs, parts datasets, brands tables and orders jobs; the
suppliers of an order's lines, one after the other, play calls.  Every order
and line counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, step, program): an order's lines, one program per line number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").repartition("l_orderkey")  # dealt once for the steps and their order
    return lines.groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("step")).agg(F.min("l_suppkey").alias("program"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed call edges (src, dst, w) between programs of consecutive steps."""
    nxt = F.lead("program").over(Window.partitionBy("job").orderBy("step"))
    return steps(spark, sf_dir).select(F.col("program").alias("src"), nxt.alias("dst")).where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))


def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): programs with a call edge."""
    return ends(calls(spark, sf_dir))


def ends(c: DataFrame) -> DataFrame:
    """(id): the ends of calls."""
    return c.select(F.col("src").alias("id")).union(c.select(F.col("dst").alias("id"))).distinct()


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program, resource, kind, mode): parts as datasets, brands as tables (big quantities), orders as jobs."""
    rows = table(spark, sf_dir, "lineitem")
    mode = F.when(F.col("l_returnflag") == "R", "WRITE").otherwise("READ")
    data = rows.select(F.col("l_suppkey").alias("program"), F.concat(F.lit("DSN:"), F.col("l_partkey").cast("string")).alias("resource"), F.lit("dataset").alias("kind"), mode.alias("mode"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    big = rows.where("l_quantity >= 45").join(part, "l_partkey")
    tables = big.select(F.col("l_suppkey").alias("program"), F.concat(F.lit("TABLE:"), "p_brand").alias("resource"), F.lit("table").alias("kind"), mode.alias("mode"))
    jobs = rows.select(F.col("l_suppkey").alias("program"), F.concat(F.lit("JOB:"), F.col("l_orderkey").cast("string")).alias("resource"), F.lit("job").alias("kind"), F.lit("READ").alias("mode"))
    return data.union(tables).union(jobs).distinct()


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program, resource, kind) of the accesses, a row per line: for counts over sets, which need no rows made distinct before."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("program"), "l_partkey", "l_orderkey", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("resource"))
    kind = lambda c, k: (F.col(c).cast("string").alias("resource"), F.lit(k).alias("kind"))
    tables = rows.where("l_quantity >= 45").join(part, "l_partkey").select("program", *kind("resource", "table"))
    return rows.select("program", *kind("l_partkey", "dataset")).union(tables).union(rows.select("program", *kind("l_orderkey", "job")))


#: The same relations as DuckDB common table expressions.
SQL = """
steps as (select l_orderkey job, l_linenumber step, min(l_suppkey) program from lineitem group by 1, 2),
nxt as (select program src, lead(program) over (partition by job order by step) dst from steps),
calls as (select src, dst, count(*)::double w from nxt where dst is not null and src <> dst group by 1, 2),
called as (select src id from calls union select dst from calls),
programs as (select s_suppkey id from supplier),
accesses as (
  select l_suppkey program, 'DSN:' || l_partkey resource, 'dataset' kind, case when l_returnflag = 'R' then 'WRITE' else 'READ' end mode from lineitem
  union select l_suppkey, 'TABLE:' || p_brand, 'table', case when l_returnflag = 'R' then 'WRITE' else 'READ' end from lineitem join part on p_partkey = l_partkey where l_quantity >= 45
  union select l_suppkey, 'JOB:' || l_orderkey, 'job', 'READ' from lineitem)
"""
