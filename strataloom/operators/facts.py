"""Facts, evidence events and access rules as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_id(*parts: Column, sep: str = "|") -> Column:
    """SHA-256 of the parts as text, joined; nulls are empty."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def two_level_digest(rows: DataFrame) -> DataFrame:
    """(digest, n) of a relation (row: text), whatever its order.

    Equal rows count by number.  Rows are dealt into 4096 buckets by the first
    three signs of their SHA-256, a bucket's digest is over its sorted (hash,
    number) pairs, and the whole is over the buckets' digests in order.
    """
    h = F.sha2(F.col("row").cast("binary"), 256)
    each = rows.groupBy(h.alias("h")).agg(F.count("*").alias("n")).withColumn("bucket", F.substring("h", 1, 3))
    text = F.concat_ws(":", "h", F.col("n").cast("string"))
    inner = each.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ","), 256).alias("d"), F.sum("n").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ",")
    return inner.agg(F.sha2(whole, 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One order-independent digest of a relation."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return two_level_digest(rows.select(row.alias("row")))


def reconcile(facts: DataFrame, anchors: DataFrame, snapshot: str) -> DataFrame:
    """Staleness of facts (fact_id, status, snapshot, paragraph, signature) against a snapshot's anchors (paragraph, signature).

    Facts of the same snapshot stay as they are; verified ones are stale on
    any change; others are stale unless an anchor of their paragraph contains
    their signature or is contained in it, which also makes stale ones fresh.
    """
    a = anchors.select("paragraph", F.col("signature").alias("anchor")).distinct()
    met = facts.join(a, "paragraph").where(F.contains("anchor", "signature") | F.contains("signature", "anchor")).select("fact_id").distinct().withColumn("met", F.lit(True))
    found = F.coalesce("met", F.lit(False))
    same = F.col("snapshot") == snapshot
    stale = F.when(same, F.col("stale")).when(F.col("status") == "VERIFIED", True).otherwise(~found)
    reason = F.when(same, F.col("reason")).when(F.col("status") == "VERIFIED", "SNAPSHOT_CHANGED").when(~found, "ANCHOR_LOST")
    return facts.join(met, "fact_id", "left").withColumns({"stale": stale, "reason": reason}).drop("met")


def cited(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (claim_id, evidence_ids) with the ids that exist and the number that don't."""
    one = claims.select("claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    known = evidence.select("evidence_id").distinct().withColumn("known", F.lit(True))
    each = one.join(known, "evidence_id", "left")
    return each.groupBy("claim_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("known"), F.col("evidence_id").cast("string")))), ",").alias("valid"),
        F.count_if(F.col("known").isNull() & F.col("evidence_id").isNotNull()).alias("missing"),
    )


#: Path prefixes and the least role that may use them, first match wins (fixed values).
ROLES = ("VIEWER", "ANALYST", "OPERATOR", "ADMIN")


def required_role(path: Column, rules: list[tuple[str, str]], default: str = "VIEWER") -> Column:
    out = F
    for prefix, role in rules:
        out = out.when(F.startswith(path, F.lit(prefix)), role)
    return out.otherwise(default)


def role_level(role: Column) -> Column:
    out = F
    for level, name in enumerate(ROLES, 1):
        out = out.when(role == name, level)
    return out.otherwise(0)
