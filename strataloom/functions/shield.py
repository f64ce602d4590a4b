"""Redaction of sensitive text, checksum validators and prompt-injection scans, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is redacted, in this order: category, pattern, and the group that is replaced (fixed values).
PATTERNS = [
    ("PRIVATE_KEY", r"(?i)-----BEGIN\s+(?:[A-Z0-9_-]+\s+)?PRIVATE\s+KEY-----[\s\S]+?-----END\s+(?:[A-Z0-9_-]+\s+)?PRIVATE\s+KEY-----", 0),
    ("DB2_PASSWORD", r"(?i)(?:USER\s+['\"][A-Za-z0-9_$-]+['\"]\s+USING\s+['\"])([^'\"]+)(?:['\"])", 1),
    ("SQL_PASSWORD", r"(?i)(?:IDENTIFIED\s+BY\s+['\"])([^'\"]+)(?:['\"])", 1),
    ("SECRET_TOKEN", r"(?i)\b(?:api[_-]?key|password|passwd|secret|auth[_-]?token|private[_-]?key)\s*[:=]\s*['\"]([A-Za-z0-9_\-+/=]{12,})['\"]", 1),
    ("PAN", r"\b(?:[0-9]{4}[-\s]?){3,4}[0-9]{1,4}\b", 0),
    ("PESEL", r"\b[0-9]{11}\b", 0),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0),
    ("IBAN", r"\bPL[0-9]{2}[-\s]?(?:[0-9]{4}[-\s]?){6}\b|\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 0),
]
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)

#: Injected instructions: name, risk and pattern (fixed values).
INJECTIONS = [
    ("OVERRIDE_DIRECTIVE", "CRITICAL", r"(?i)(?:ignore|disregard|forget|bypass|override)\s+(?:all\s+)?(?:previous|prior|system|above)\s+(?:instructions|prompts|rules|directives)"),
    ("SYSTEM_PROMPT_INJECTION", "CRITICAL", r"(?i)\[\s*(?:system|assistant|system\s+directive|developer\s+instruction)\b[^\]]*\]"),
    ("JAILBREAK_KEYWORD", "HIGH", r"(?i)\b(?:DAN|STAN|DUDE|jailbreak|unfiltered\s+mode|developer\s+mode|uncensored)\b"),
    ("DELIMITER_BREAKOUT", "HIGH", r"(?i)```(?:json|markdown|python|yaml)?\s*\n\s*(?:stop|end|system|eval)"),
    ("AUTONOMOUS_GATE_FORGERY", "HIGH", r"(?i)(?:claim\s+is\s+verified|promote\s+to\s+verified|status\s*[:=]\s*['\"]?VERIFIED['\"]?|certify\s+release)"),
]
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}\x{2060}\x{202A}-\x{202E}]"
#: Risks from none to the highest (fixed values).
RISKS = ("SAFE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
#: What sanitising puts in place of what (fixed values).
DEFANGED = [
    (r"(?i)\[\s*(system|assistant|developer)[^\]]*\]", "[DEFANGED_$1]"),
    (r"(?i)\b(ignore|disregard|forget|bypass)\s+(all\s+)?(previous|prior|system)\s+(instructions|prompts|directives|rules)\b", "[BLOCKED_INJECTION_DIRECTIVE]"),
]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def card_number(text: Column) -> Column:
    """13 to 19 digits that pass Luhn's check."""
    d = digits(text)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def pesel(text: Column) -> Column:
    """Eleven digits with a right check digit."""
    d = digits(text)
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(PESEL_WEIGHTS)), F.lit(0))
    return (F.length(d) == 11) & ((10 - total % 10) % 10 == F.substring(d, 11, 1).cast("int"))


CHECKS = {"PAN": card_number, "PESEL": pesel}


def mask(category: str, salt: str | None = None):
    """What stands in for a match: its category, with a salt also twelve signs of a salted hash."""

    def token(raw: Column) -> Column:
        if salt is None:
            return F.lit(f"[REDACTED:{category}]")
        return F.concat(F.lit(f"[HASH:{category}:"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), raw), 256), 1, 12), F.lit("]"))

    return token


def matches(text: Column, category: str, pattern: str, group: int) -> Column:
    """The matches of a category in a text, in order; numbers only where their check digit is right."""
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    return F.filter(found, CHECKS[category]) if category in CHECKS else found


def _without(text: Column, found: Column, token) -> Column:
    return F.aggregate(F.array_distinct(found), text, lambda acc, raw: F.replace(acc, raw, token(raw)))


def redact(text: Column, salt: str | None = None) -> Column:
    """A text with all sensitive matches replaced, category after category; a match is replaced wherever it stands."""
    for category, pattern, group in PATTERNS:
        text = _without(text, matches(text, category, pattern, group), mask(category, salt))
    return text


def redact_column(df: DataFrame, column: str, salt: str | None = None, counts: bool = False) -> DataFrame:
    """``df`` with a text column redacted, step by step, so that each step's text is computed once, where ``redact`` nests them.

    With ``counts`` a column per category (in lower case) says how many matches it replaced.
    """
    for category, pattern, group in PATTERNS:
        found = matches(F.col(column), category, pattern, group)
        if counts:
            df = df.withColumn(category.lower(), F.coalesce(F.size(found), F.lit(0)).cast("long"))
        df = df.withColumn(column, _without(F.col(column), found, mask(category, salt)))
    return df


def _findings(text: Column, name: str, risk: str, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.transform(found, lambda m: F.struct(F.lit(name).alias("name"), F.lit(risk).alias("risk"), m.alias("snippet")))


def injection_findings(text: Column) -> Column:
    """Array of (name, risk, snippet): hidden signs first, then the matches rule by rule."""
    hidden = F.regexp_count(text, F.lit(ZERO_WIDTH))
    none = F.array().cast("array<struct<name:string,risk:string,snippet:string>>")
    sign = F.struct(F.lit("ZERO_WIDTH_STEGANOGRAPHY").alias("name"), F.lit("MEDIUM").alias("risk"), F.concat(hidden.cast("string"), F.lit(" hidden unicode characters")).alias("snippet"))
    parts = [F.when(hidden > 0, F.array(sign)).otherwise(none)]
    parts += [_findings(text, *rule) for rule in INJECTIONS]
    return F.concat(*parts)


def injection_risk(text: Column) -> Column:
    """SAFE to CRITICAL: the highest risk of what is found; hidden signs are MEDIUM."""
    level = [F.when(text.rlike(p), RISKS.index(r)).otherwise(0) for _, r, p in INJECTIONS]
    worst = F.greatest(*level, F.when(text.rlike(ZERO_WIDTH), RISKS.index("MEDIUM")).otherwise(0))
    return F.element_at(F.array(*[F.lit(r) for r in RISKS]), worst + 1)


def is_safe(text: Column) -> Column:
    return injection_risk(text).isin("SAFE", "LOW")


def sanitise(text: Column, *, strict: bool = False) -> Column:
    """Without hidden signs, role marks and overriding commands defanged; strict mode raises on HIGH and CRITICAL risk."""
    clean = F.regexp_replace(text, ZERO_WIDTH, "")
    for pattern, put in DEFANGED:
        clean = F.regexp_replace(clean, pattern, put)
    if strict:
        return F.when(injection_risk(text).isin("HIGH", "CRITICAL"), F.raise_error(F.lit("injected instructions")).cast("string")).otherwise(clean)
    return clean
