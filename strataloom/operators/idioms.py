"""Code idioms by windows over statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import first_verb


def mine(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program, idiom, instances, anchors): anchors are node ids in order, joined by commas."""
    verb = F.regexp_replace(first_verb(F.upper("code"), F.upper("label"), F.upper("node_type")), "^EXEC_CICS$", "EXEC_CICS")
    rows = nodes.where(F.col("line") > 0).select("program", "seq", "id", "paragraph", verb.alias("verb"))
    order = Window.partitionBy("program").orderBy("seq")

    def beside(k: int):
        near = F.lead("verb", k).over(order) if k > 0 else F.lag("verb", -k).over(order)
        same = (F.lead("paragraph", k).over(order) if k > 0 else F.lag("paragraph", -k).over(order)) == F.col("paragraph")
        return F.when(same, near)

    rows = rows.withColumns({"n1": beside(1), "n2": beside(2), "p1": beside(-1), "p2": beside(-2), "entry": F.first("paragraph").over(order)})
    test = ("IF", "EVALUATE")
    checked = rows.where(F.col("verb").isin("CALL", "EXEC_SQL", "EXEC_CICS") & (F.col("n1").isin(*test) | (F.col("n1").isNotNull() & F.col("n2").isin(*test))))
    guarded = rows.where(F.col("verb").isin("STOP", "GOBACK") & (F.col("p1").isin(*test) | F.col("p2").isin(*test)))
    first = rows.where((F.col("paragraph") == F.col("entry")) & F.col("verb").isin("MOVE", "INITIALIZE", "SET"))
    initial = first.groupBy("program").agg(F.count("*").alias("n"), F.min_by("id", "seq").alias("id")).where("n >= 2").select("program", "id", F.lit(0).alias("seq"))
    failing = rows.where(F.upper("paragraph").rlike("ERROR|FAIL|ABEND|EXCEPTION"))
    into = edges.select("program", F.col("dst").alias("id")).join(failing.select("program", "id", "paragraph"), ["program", "id"]).groupBy("program", "paragraph").agg(F.count("*").alias("n")).where("n >= 2")
    central = failing.groupBy("program", "paragraph").agg(F.min_by("id", "seq").alias("id"), F.min("seq").alias("seq")).join(into, ["program", "paragraph"]).select("program", "id", "seq")
    named = {"DEFENSIVE_STATUS_CHECK": checked, "CENTRALIZED_ERROR_PARAGRAPH": central, "INITIALIZATION_AT_ENTRY": initial, "TERMINAL_GOBACK_GUARD": guarded}
    parts = [df.select("program", F.lit(n).alias("idiom"), "seq", "id") for n, df in named.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.groupBy("program", "idiom").agg(F.count("*").alias("instances"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]), ",").alias("anchors"))
