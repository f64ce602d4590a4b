"""Evidence events, provenance and signed envelopes as relations."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of an event; no others are allowed (fixed values).
FIELDS = ("event_id", "event_type", "schema_version", "project_id", "observed_at", "epistemic_status", "payload")
STATUSES = ("OBSERVED", "INFERRED", "VERIFIED", "UNRESOLVED")
MAX_EVENTS, MAX_BYTES = 1_024, 10 << 20
EVENT = "event_id string, event_type string, schema_version string, project_id string, observed_at string, epistemic_status string, payload string"


def utc(text: Column) -> Column:
    """An ISO time with an offset as UTC with Z; times without an offset are errors."""
    ok = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    value = F.date_format(F.to_utc_timestamp(F.to_timestamp(text), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit("a time without offset: "), text)).cast("string"))


def event_id(row: dict[str, Column]) -> Column:
    """The content address of an event: SHA-256 over its other fields in order."""
    return F.concat(F.lit("event:sha256:"), F.sha2(F.concat_ws("\u001f", *[row[c] for c in FIELDS[1:]]), 256))


def events(rows: DataFrame, *, project: str, kind: str, version: str = "v1") -> DataFrame:
    """Events of rows (observed_at, epistemic_status, payload as a JSON text)."""
    row = {"event_type": F.lit(kind), "schema_version": F.lit(version), "project_id": F.lit(project), "observed_at": utc(F.col("observed_at")), "epistemic_status": F.col("epistemic_status"), "payload": F.col("payload")}
    flat = rows.select(*[e.alias(c) for c, e in row.items()])
    return flat.select(event_id({c: F.col(c) for c in row}).alias("event_id"), *row)


def to_lines(df: DataFrame) -> DataFrame:
    """(value): one JSON line per event, fields in order, nulls kept."""
    return df.select(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("value"))


def from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected): lines that don't parse, have other fields, a wrong status or a wrong id are rejected with a reason."""
    parsed = lines.select("value", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"), F.from_json("value", "map<string,string>").alias("m"))
    keys = F.array_sort(F.map_keys("m"))
    want = F.array(*[F.lit(f) for f in sorted(FIELDS)])
    right_id = event_id({c: F.col(f"e.{c}") for c in FIELDS})
    reason = (
        F.when(F.col("e").isNull() | F.col("m").isNull(), "not JSON").when(keys != want, "fields").when(~F.col("e.epistemic_status").isin(*STATUSES), "status")
        .when(F.col("e.event_id") != right_id, "checksum")
    )
    checked = parsed.withColumn("reason", reason)
    return checked.where("reason is null").select("e.*"), checked.where("reason is not null").select("value", "reason")


def bounded(lines: DataFrame, *, most: int = MAX_EVENTS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """The lines of one exchanged file; more than ``most`` events or ``most_bytes`` bytes are an error."""
    size = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes")).first()
    if size.n > most or size["bytes"] > most_bytes:
        raise ValueError(f"a file holds {most} events of {most_bytes} bytes at most, this one has {size.n} of {size['bytes']}")
    return lines


def finding_counts(findings: DataFrame) -> DataFrame:
    """(counts): one map from kind to number of findings (kind)."""
    per = findings.groupBy("kind").agg(F.count("*").alias("n"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"))


def graph_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program, digest): order-independent SHA-256 of a program's nodes and existing edges."""
    ends = edges.join(nodes.select("program", F.col("id").alias("src")), ["program", "src"], "left_semi").join(nodes.select("program", F.col("id").alias("dst")), ["program", "dst"], "left_semi")
    n = nodes.select("program", F.concat_ws("|", F.lit("n"), "id", "node_type").alias("row"))
    e = ends.select("program", F.concat_ws("|", F.lit("e"), "src", "dst", "edge_type", F.col("weight").cast("string")).alias("row"))
    return n.union(e).groupBy("program").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "\n"), 256).alias("digest"))


def sign(payload: str, key: bytes) -> dict[str, str]:
    """An HMAC-SHA256 envelope of a text."""
    return {"algorithm": "HMAC-SHA256", "payload_sha256": hashlib.sha256(payload.encode()).hexdigest(), "signature": hmac.new(key, payload.encode(), hashlib.sha256).hexdigest()}


def verify(payload: str, envelope: dict[str, str], key: bytes) -> bool:
    good = sign(payload, key)
    return hmac.compare_digest(good["signature"], envelope.get("signature", "")) and good["algorithm"] == envelope.get("algorithm")


def sign_rows(df: DataFrame, column: str, key: bytes) -> DataFrame:
    """Adds ``signature`` of a text column; batches of rows go through Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(signature=[None if t is None else sign(t, key)["signature"] for t in batch[column]])

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", signature string")


def tokens(df: DataFrame, key: bytes, now: int) -> DataFrame:
    """Checks access tokens (token: base64url claims, a point, hex signature): (token, subject, role, status).

    ``status`` is VALID, MALFORMED, FORGED or EXPIRED; claims are JSON with sub, role and exp.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        for batch in batches:
            out = []
            for token in batch["token"]:
                body, _, signature = (token or "").partition(".")
                try:
                    claims = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
                    subject, role, expires = claims["sub"], claims["role"], int(claims["exp"])
                except (ValueError, KeyError, TypeError):
                    out.append((token, None, None, "MALFORMED"))
                    continue
                good = hmac.compare_digest(hmac.new(key, body.encode(), hashlib.sha256).hexdigest(), signature)
                out.append((token, subject, role, "FORGED" if not good else "EXPIRED" if expires <= now else "VALID"))
            yield pd.DataFrame(out, columns=["token", "subject", "role", "status"])

    return df.select("token").mapInPandas(run, "token string, subject string, role string, status string")
