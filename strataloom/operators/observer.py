"""What an outside model may see and say: prepared prompts, and a gate for its answers.  No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import shield

ANSWER = "struct<hypotheses:array<struct<hypothesis_id:string,status:string,claim:string,cited_evidence_ids:array<string>>>,review_questions:array<string>>"


def prompt(text: Column) -> Column:
    """A slice of source as a prompt may hold it: commands defanged, sensitive values redacted."""
    return shield.redact(shield.sanitise(F.coalesce(text, F.lit(""))))


def unfenced(text: Column) -> Column:
    """The content of a text that stands in a Markdown code fence, other texts as they are."""
    clean = F.trim(text)
    inner = F.regexp_replace(F.regexp_replace(clean, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(F.startswith(clean, F.lit("```")), inner).otherwise(clean)


def answers(raw: DataFrame) -> DataFrame:
    """(packet_id, at, hypothesis_id, claimed, claim, cited) of model answers (packet_id, answer); what isn't JSON has no hypotheses."""
    parsed = raw.select("packet_id", F.from_json(unfenced(F.col("answer")), ANSWER).alias("a"))
    each = parsed.select("packet_id", F.posexplode("a.hypotheses").alias("at", "h"))
    ident = F.coalesce("h.hypothesis_id", F.concat(F.lit("hyp:model:"), F.col("at").cast("string")))
    none = F.array().cast("array<string>")
    return each.select("packet_id", "at", ident.alias("hypothesis_id"), F.coalesce("h.status", F.lit("INFERRED")).alias("claimed"), F.coalesce("h.claim", F.lit("")).alias("claim"), F.coalesce("h.cited_evidence_ids", none).alias("cited"))


def gated(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hypotheses as they may be kept: always INFERRED, citing only evidence (packet_id, evidence_id) of their packet, in their order.

    ``downgraded`` says that the model claimed VERIFIED, ``stripped`` how many
    citations had no evidence.
    """
    known = evidence.select("packet_id", F.col("evidence_id").alias("c")).distinct().withColumn("known", F.lit(True))
    cites = hypotheses.select("packet_id", "at", F.posexplode("cited").alias("k", "c")).join(known, ["packet_id", "c"], "left")
    per = cites.groupBy("packet_id", "at").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("k", "c")))), lambda x: x["c"]).alias("cited"), F.count_if(F.col("known").isNull()).alias("stripped")
    )
    out = hypotheses.drop("cited").join(per, ["packet_id", "at"], "left")
    return out.select(
        "packet_id", "at", "hypothesis_id", F.lit("INFERRED").alias("status"), "claim", F.coalesce("cited", F.array().cast("array<string>")).alias("cited"),
        (F.col("claimed") == "VERIFIED").alias("downgraded"), F.coalesce("stripped", F.lit(0)).cast("long").alias("stripped"),
    )
