"""Composed reports: corpus evaluation, drift radar, dossiers, and Markdown of small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import shield
from strataloom.functions.text import first_verb, markdown_escape
from strataloom.operators import control_flow, coupling, cycles, graph, portfolio


def corpus_evaluation(sources: DataFrame, programs: DataFrame) -> DataFrame:
    """Per program: code lines (not blank, no star first), statements, unsupported ones, coverage, nodes, edges, verdict."""
    line = F.trim(F.col("l"))
    loc = sources.select("program", F.explode(F.split("source", "\n")).alias("l")).groupBy("program").agg(F.count_if((line != "") & ~line.startswith("*")).alias("loc"))
    nodes, edges = control_flow.nodes(programs), control_flow.edges(programs)
    sizes = nodes.groupBy("program").agg(F.count("*").alias("nodes")).join(edges.groupBy("program").agg(F.count("*").alias("edges")), "program", "left")
    report = cycles.analyse(nodes, edges).select("program", "n_sccs", "n_cycles", "verdict")
    return loc.join(control_flow.coverage(programs), "program").join(sizes, "program", "left").join(report, "program", "left").fillna(0, ["nodes", "edges", "n_sccs", "n_cycles"])


def corpus_totals(evaluation: DataFrame) -> DataFrame:
    """One row: totals, aggregate coverage (over statements) and mean coverage (over programs)."""
    s, u = F.sum("total"), F.sum("unsupported")
    return evaluation.agg(
        F.count("*").alias("programs"), F.sum("loc").alias("loc"), s.alias("statements"), (s - u).alias("supported"),
        F.when(s > 0, F.round((s - u) / s, 4)).otherwise(1.0).alias("aggregate_coverage"), F.round(F.avg("ratio"), 4).alias("mean_coverage"), F.sum("n_sccs").alias("sccs"),
    )


def unsupported_verbs(programs: DataFrame) -> DataFrame:
    n = control_flow.nodes(programs).where("node_type = 'unsupported_stmt'")
    return n.groupBy(first_verb(F.col("code"), F.col("label"), F.col("node_type")).alias("verb")).agg(F.count("*").alias("n"))


def radar(base: DataFrame, now: DataFrame) -> DataFrame:
    """Drift candidates between two summaries per program (program, fiedler, trace, trace_error, coverage, n_cycles).

    A spectral distance counts only above the noise floor, twice the greatest
    standard error of either trace; priority grows with distance.
    """
    a = base.select("program", *[F.col(c).alias(f"{c}_a") for c in ("fiedler", "trace", "trace_error", "coverage", "n_cycles")])
    b = now.select("program", *[F.col(c).alias(f"{c}_b") for c in ("fiedler", "trace", "trace_error", "coverage", "n_cycles")])
    both = a.join(b, "program")
    from strataloom.operators.compare import distance

    d = distance(F.col("trace_a"), F.col("trace_b"))
    floor = 2 * F.greatest(F.array_max("trace_error_a"), F.array_max("trace_error_b"))
    fiedler, coverage, more = F.col("fiedler_b") - F.col("fiedler_a"), F.col("coverage_b") - F.col("coverage_a"), F.col("n_cycles_b") - F.col("n_cycles_a")
    spectral = (d > floor) & (d >= 0.05)
    rows = both.select("program", d.alias("distance"), floor.alias("noise_floor"), fiedler.alias("fiedler_delta"), coverage.alias("coverage_delta"), more.alias("cycle_delta"), spectral.alias("spectral"))
    kinds = F.array_compact(F.array(F.when(F.col("spectral"), "SPECTRAL_DRIFT"), F.when(F.abs("fiedler_delta") >= 0.04, "CONNECTIVITY_DRIFT"), F.when(F.col("coverage_delta") <= -0.1, "COVERAGE_LOSS"), F.when(F.col("cycle_delta") > 0, "NEW_CYCLES")))
    priority = F.when((F.col("distance") >= 0.15) | (F.col("cycle_delta") > 0), "HIGH").when(F.size(kinds) > 0, "MEDIUM").otherwise("LOW")
    return rows.select("program", "distance", "noise_floor", "fiedler_delta", "coverage_delta", "cycle_delta", F.array_join(kinds, ",").alias("candidates"), priority.alias("priority"))


def dossier(nodes: DataFrame, edges: DataFrame, access: DataFrame | None = None) -> DataFrame:
    """Per program of a portfolio: barriers, blast radius, separability index, risk and migration wave.

    If the first or the last wave is empty, the programs of least blast (most,
    for the last) of the second move there.
    """
    programs = nodes.where("node_type = 'program'").select("id")
    access = portfolio.accesses(edges) if access is None else access
    calls = edges.where(F.col("edge_type").isin(*portfolio.CALLS)).select("src", "dst")
    per = coupling.pair_sums(access, calls).select("id", (F.col("barred_after") + F.col("barred_before")).alias("barriers"), (F.col("after") + F.col("before")).alias("partners"))
    blast = graph.reach_counts(graph.reverse(calls), programs).withColumnRenamed("n", "blast")
    rows = programs.join(per, "id", "left").join(blast, "id", "left").fillna(0, ["barriers", "partners", "blast"])
    share = F.when(F.col("partners") > 0, F.col("barriers") / F.col("partners")).otherwise(0.0)
    rows = rows.withColumn("index", coupling.separability(share, F.col("barriers")))
    rows = rows.withColumns({"risk": coupling.risk_grade(F.col("index")), "wave": coupling.migration_wave(F.col("barriers") > 0, F.col("blast"))})
    all_ = Window.partitionBy()
    second = Window.partitionBy("wave").orderBy("blast", "id")
    last = Window.partitionBy("wave").orderBy(F.desc("blast"), F.desc("id"))
    rows = rows.withColumns({"none1": F.count_if(F.col("wave") == 1).over(all_) == 0, "none3": F.count_if(F.col("wave") == 3).over(all_) == 0, "r": F.row_number().over(second), "s": F.row_number().over(last), "n2": F.count_if(F.col("wave") == 2).over(all_)})
    moved = F.when((F.col("wave") == 2) & F.col("none1") & (F.col("r") == 1), 1).when((F.col("wave") == 2) & F.col("none3") & (F.col("s") == 1) & (F.col("n2") > 1), 3).otherwise(F.col("wave"))
    return rows.select("id", "barriers", "blast", "index", "risk", moved.alias("wave"))


def rationale(conductance: Column, crossing: Column, barriers: Column) -> Column:
    """A recommendation for a cut from its conductance, crossing edges and barriers."""
    return F.when(barriers > 0, "SPLIT_DATA_FIRST").when(conductance <= 0.05, "EXTRACT_NOW").when(conductance <= 0.20, "EXTRACT_WITH_ADAPTER").when(crossing == 0, "ALREADY_SEPARATE").otherwise("KEEP_TOGETHER")


def markdown(df: DataFrame, title: str, *, limit: int = 25, redact: bool = True) -> str:
    """A Markdown table of the first rows (a report's preview), cells escaped and redacted."""
    cells = []
    for c in df.columns:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        cells.append(markdown_escape(shield.redact(text) if redact else text).alias(c))
    rows = df.select(*cells).limit(limit).collect()
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"
