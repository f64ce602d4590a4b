"""Program graphs from source rows: parsing in a map over programs, linking as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.sources.cobol import program_rows

NODE = "seq int, id string, label string, node_type string, paragraph string, code string, reads array<string>, writes array<string>, line int, verb string, operation string, tables array<string>, target string"
EDGE = "seq int, src string, dst string, edge_type string, weight double, label string"
PARAGRAPH = "seq int, name string, entry string, exits array<string>"
VARIABLE = "name string, pic string, initial_value string, level int"


def _struct(ddl: str) -> str:
    return "array<struct<" + ", ".join(f"{p.strip().split(' ')[0]}:{p.strip().split(' ', 1)[1]}" for p in ddl.split(", ")) + ">>"


def parsed(sources: DataFrame, library: dict[str, str] | None = None, *, legacy: bool = False) -> DataFrame:
    """One row per source (program, source): its parsed graph as nested arrays, or the error that kept it from being parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, source in zip(batch["program"], batch["source"], strict=True):
                try:
                    program, nodes, edges, paragraphs = program_rows(source or "", library, legacy=legacy)
                except ValueError as e:
                    out.append((key, None, [], [], [], [], str(e)))
                    continue
                number = [[{"seq": i, **r} for i, r in enumerate(rows)] for rows in (nodes, edges)]
                variables = [{"name": n, "pic": p, "initial_value": v, "level": lv} for n, (p, v, lv) in program.variables.items()]
                out.append((key, program.program_id, *number, paragraphs, variables, None))
            yield pd.DataFrame(out, columns=["program", "program_id", "nodes", "edges", "paragraphs", "variables", "error"])

    schema = f"program string, program_id string, nodes {_struct(NODE)}, edges {_struct(EDGE)}, paragraphs {_struct(PARAGRAPH)}, variables {_struct(VARIABLE)}, error string"
    return sources.select("program", "source").mapInPandas(run, schema)


def _rows(programs: DataFrame, what: str) -> DataFrame:
    return programs.select("program", F.explode(what).alias("r")).select("program", "r.*")


def nodes(programs: DataFrame) -> DataFrame:
    return _rows(programs, "nodes")


def variables(programs: DataFrame) -> DataFrame:
    return _rows(programs, "variables")


def paragraphs(programs: DataFrame) -> DataFrame:
    return _rows(programs, "paragraphs")


def edges(programs: DataFrame) -> DataFrame:
    """All edges (program, src, dst, edge_type, weight, label) of the parsed programs."""
    node, block = nodes(programs), _rows(programs, "edges")
    paragraph = _rows(programs, "paragraphs")
    entry = paragraph.where("entry is not null").select("program", F.col("name").alias("target"), F.col("entry"), "exits").dropDuplicates(["program", "target"])

    performs = node.where("node_type = 'perform'").select("program", F.col("seq").alias("at"), F.col("id").alias("perform"), "paragraph", "target")
    calls = performs.join(entry, ["program", "target"])
    called = calls.select("program", F.col("perform").alias("src"), F.col("entry").alias("dst"), F.lit("cfg_call").alias("edge_type"), F.lit(1.5).alias("weight"), F.lit("call").alias("label"))

    control = block.where(F.col("edge_type").isin("cfg_seq", "cfg_branch_true", "cfg_branch_false"))
    nxt = control.groupBy("program", F.col("src").alias("perform")).agg(F.min_by("dst", "seq").alias("next"))
    back = (
        calls.where("target <> paragraph").join(nxt, ["program", "perform"])
        .select("program", F.explode("exits").alias("src"), "perform", F.col("next").alias("dst")).where("src <> perform")
        .select("program", "src", "dst", F.lit("cfg_return").alias("edge_type"), F.lit(1.2).alias("weight"), F.lit("return").alias("label"))
    )

    order = Window.partitionBy("program").orderBy("seq")
    falls = paragraph.select("program", "exits", F.lead("name").over(order).alias("target"))
    falls = falls.join(entry.select("program", "target", "entry"), ["program", "target"]).select("program", F.explode("exits").alias("src"), F.col("entry").alias("dst"))
    have = block.select("program", "src", "dst").union(called.select("program", "src", "dst")).union(back.select("program", "src", "dst"))
    falls = falls.distinct().join(have, ["program", "src", "dst"], "left_anti").select(
        "program", "src", "dst", F.lit("cfg_fallthrough").alias("edge_type"), F.lit(0.8).alias("weight"), F.lit("fallthrough").alias("label")
    )

    writes = node.select("program", F.col("id").alias("src"), F.explode("writes").alias("var"))
    reads = node.select("program", F.col("id").alias("dst"), F.explode("reads").alias("var"))
    uses = writes.join(reads, ["program", "var"]).where("src <> dst").select(
        "program", "src", "dst", F.lit("dfg_def_use").alias("edge_type"), F.lit(1.0).alias("weight"), F.concat(F.lit("def_use("), "var", F.lit(")")).alias("label")
    )
    return block.drop("seq").unionByName(called).unionByName(back).unionByName(falls).unionByName(uses)


def with_variables(programs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a node per declared variable and its read and write edges."""
    node = nodes(programs)
    declared = variables(programs).select("program", F.col("name").alias("var")).distinct()
    var_node = declared.select("program", F.concat(F.lit("var_"), "var").alias("id"), F.lit("var").alias("node_type"))

    def touch(column: str, kind: str, weight: float) -> DataFrame:
        rows = node.select("program", "id", F.explode(column).alias("var")).join(declared, ["program", "var"], "left_semi")
        var = F.concat(F.lit("var_"), F.col("var"))
        src, dst = (var, F.col("id")) if column == "reads" else (F.col("id"), var)
        return rows.select("program", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"), F.lit(kind).alias("label"))

    all_edges = edges(programs).unionByName(touch("reads", "dfg_read", 1.2)).unionByName(touch("writes", "dfg_write", 1.5))
    return node.select("program", "id", "node_type").union(var_node), all_edges


STATEMENTS = ("stmt", "branch", "perform", "stop", "db_access", "external", "unsupported_stmt")


def coverage(programs: DataFrame) -> DataFrame:
    """Per program: statements, unsupported ones, and the supported share (1 without statements)."""
    n = nodes(programs).where(F.col("node_type").isin(*STATEMENTS))
    bad = F.col("node_type") == "unsupported_stmt"
    per = n.groupBy("program").agg(F.count("*").alias("total"), F.count_if(bad).alias("unsupported"))
    per = programs.select("program").join(per, "program", "left").fillna(0, ["total", "unsupported"])
    return per.withColumn("ratio", F.when(F.col("total") > 0, F.round((F.col("total") - F.col("unsupported")) / F.col("total"), 4)).otherwise(1.0))
