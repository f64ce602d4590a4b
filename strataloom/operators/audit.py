"""Audit reports: findings of programs, with the statements they rest on, and metrics with what they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import control_flow

FINDING = ("program", "id", "kind", "severity", "message", "code", "nodes", "line", "paragraph")

#: What each metric says, and what it doesn't (own words).
MEANING = {
    "parser_coverage_ratio": "Supported statements over all statements, 1 without any; says nothing about dialects.",
    "unsupported_statement_count": "Statements that were kept without being modelled.",
    "graph_node_count": "Statements and resources, and the declared variables as nodes of their own.",
    "graph_edge_count": "Control, call and data edges and those of variables; parallel edges count each.",
    "fiedler_value": "Second least eigenvalue of the Laplacian; a measure of structure, not of correctness.",
    "diffusion_half_life": "ln 2 over half the Fiedler value; not a time that was observed.",
    "enumerated_cycle_count": "Simple cycles that the bounded search listed; there may be more.",
    "non_trivial_scc_count": "Strong components of several statements, or with a statement that follows itself.",
    "trapped_scc_count": "Such components without a path to a stop; no proof that a run never ends.",
    "reaches_terminal": "1 if some path leads from the first statement to a stop.",
}


def findings(programs: DataFrame, cycles: DataFrame) -> DataFrame:
    """``FINDING`` rows of parsed ``programs`` and their ``cycles`` reports: gaps in coverage, cycles, trapped components, hazards."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, ident, kind: str, severity: str, message, code, nodes, line, paragraph) -> DataFrame:
        columns = (F.col("program"), ident, F.lit(kind), F.lit(severity), message, code, nodes, line.cast("int"), paragraph)
        return df.select(*[c.alias(n) for c, n in zip(columns, FINDING, strict=True)])

    gaps = control_flow.nodes(programs).where("node_type = 'unsupported_stmt'")
    out = rows(
        gaps, F.concat(F.lit("unsupported:"), "id"), "unsupported_statement", "coverage_gap", F.concat(F.lit("The verb "), "verb", F.lit(" is not modelled.")),
        F.col("code"), F.array("id"), F.col("line"), F.col("paragraph"),
    )
    each = cycles.select("program", F.posexplode("cycles").alias("at", "c"))
    said = F.when(F.col("c.invariant"), "A cycle whose guards nothing in it changes.").when(F.col("c.recursive"), "A cycle through a PERFORM.").otherwise("A cycle of the control flow.")
    out = out.union(rows(each, F.concat(F.lit("cycle:"), (F.col("at") + 1).cast("string")), "reported_control_flow_cycle", "review", said, none, F.col("c.nodes"), F.lit(None), none))
    trapped = cycles.where("n_trapped > 0").select("program", F.explode(F.sequence(F.lit(1), "n_trapped")).alias("k"))
    message = F.lit("A strong component without a path to a stop.")
    out = out.union(rows(trapped, F.concat(F.lit("trapped_scc:"), F.col("k").cast("string")), "trapped_control_flow_component", "review", message, none, F.array().cast("array<string>"), F.lit(None), none))
    hazard = cycles.where("deadlock")
    message = F.concat(F.lit("The cycle analysis reports "), "verdict")
    return out.union(rows(hazard, F.lit("cycle-analysis:heuristic-hazard"), "cycle_analysis_heuristic", "review", message, none, F.array_distinct(F.flatten(F.transform("cycles", lambda c: c["nodes"]))), F.lit(None), none))


def metrics(programs: DataFrame, cycles: DataFrame, spectra: DataFrame | None = None) -> DataFrame:
    """(program, metric, value, meaning) of every program; spectral ones from ``spectra`` (program, fiedler, half_life) if given."""
    nodes, edges = control_flow.with_variables(programs)
    sizes = nodes.groupBy("program").agg(F.count("*").alias("graph_node_count")).join(edges.groupBy("program").agg(F.count("*").alias("graph_edge_count")), "program", "left")
    all_ = control_flow.coverage(programs).select("program", F.col("ratio").alias("parser_coverage_ratio"), F.col("unsupported").alias("unsupported_statement_count"))
    all_ = all_.join(sizes, "program", "left").join(
        cycles.select("program", F.col("n_cycles").alias("enumerated_cycle_count"), F.col("n_sccs").alias("non_trivial_scc_count"), F.col("n_trapped").alias("trapped_scc_count"), F.col("reaches_terminal").cast("int").alias("reaches_terminal")),
        "program", "left",
    )
    if spectra is not None:
        all_ = all_.join(spectra.select("program", F.col("fiedler").alias("fiedler_value"), F.col("half_life").alias("diffusion_half_life")), "program", "left")
    names = [m for m in MEANING if m in all_.columns]
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0) if "count" in m else F.lit(None)).alias("value"), F.lit(MEANING[m]).alias("meaning")) for m in names])).alias("m")
    return all_.select("program", long).select("program", "m.*")
