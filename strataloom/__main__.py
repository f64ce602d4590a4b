"""python -m strataloom SOURCE... : cycle verdict, coverage and spectrum of COBOL files; --compare A B: their structural difference."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main() -> None:
    args = argparse.ArgumentParser(prog="strataloom")
    args.add_argument("files", nargs="+")
    args.add_argument("--compare", action="store_true")
    given = args.parse_args()

    from strataloom.operators import control_flow, cycles, reports, spectral

    spark = SparkSession.builder.appName("strataloom").getOrCreate()
    sources = spark.read.text(given.files, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("program"), F.col("value").alias("source"))
    parsed = control_flow.parsed(sources).cache()
    report = cycles.analyse(control_flow.nodes(parsed), control_flow.edges(parsed))
    summary = spectral.summaries(*control_flow.with_variables(parsed)).join(report.select("program", "deadlock", "verdict"), "program")
    if given.compare:
        names = [f.rsplit("/", 1)[-1] for f in given.files[:2]]
        sides = [summary.where(F.col("program") == n).withColumn("pair", F.lit(" / ".join(names))) for n in names]
        print(reports.markdown(spectral.comparison(*sides), "Comparison"))
    else:
        rows = summary.join(control_flow.coverage(parsed), "program").select("program", "n", F.round("fiedler", 4).alias("fiedler"), F.round("half_life", 3).alias("half_life"), "verdict", "ratio")
        print(reports.markdown(rows, "Programs"))
    spark.stop()


if __name__ == "__main__":
    main()
