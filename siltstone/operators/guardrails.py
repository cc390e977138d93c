"""Checks on what goes in and out: input patterns, output secrets, payload keys, egress, review routing, block rates, audit pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import canonical, casefold, entropy

#: Signs of an attempt to get around instructions, in this order.
INPUT_PATTERNS = (
    r"ignore\s+(all\s+)?(previous|above|prior)?\s*instructions?",
    r"disregard\s+(all\s+)?(previous|above|prior)?\s*(instructions?|rules?)",
    r"system\s+prompt",
    r"reveal\s+(your\s+)?(instructions?|prompt|system|configuration)",
    r"you\s+are\s+now\s+(a|an)?\s*\w+",
    r"act\s+as\s+(a\s+|an\s+)?(unrestricted|jailbroken|root|admin)",
    r"output\s+only\s+(the\s+)?(password|secret|key|token|system)",
    r"bỏ\s+qua\s+(mọi\s+)?hướng\s+dẫn",
    r"tiết\s+lộ\s+(mật\s+khẩu|system\s*prompt)",
)
#: What must not leave in an answer.
OUTPUT_RULES = {
    "EMAIL": r"[\w.-]+@[\w.-]+\.[a-zA-Z]{2,}",
    "PHONE_NUMBER": r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "API_OR_SECRET_KEY": r"\b(?:sk|pk|api|key|token|sec)[-_][a-zA-Z0-9_-]{8,}\b",
    "PRIVATE_KEY_HEADER": r"-----BEGIN [A-Z ]+PRIVATE KEY-----",
}
#: Single characters with separators between them, six or more.
SPACED_OUT = r"(?<![a-zA-Z0-9])(?:[a-zA-Z0-9][\s\-_.\\/]+){5,}[a-zA-Z0-9](?![a-zA-Z0-9])"
#: Keys that must not go to external parties, and the form of credentials.
RESTRICTED_KEYS = ("employee_id", "asset_id", "serial_number", "password", "secret", "token", "api_key", "ssn", "internal_ip")
CREDENTIAL = r"(bearer\s+[a-zA-Z0-9_\-\.]{20,}|ghp_[a-zA-Z0-9]{36}|sk-[a-zA-Z0-9]{32,}|password\s*[:=]\s*\S+)"
PAYLOAD_SIGNS = ("begin private key", "bearer ", "sk-", "password=")


def input_reason(text: Column, canonicalize: bool = True) -> Column:
    """The first pattern that the (canonical) text matches, null if it is clean. Null texts are clean."""
    t = canonical(text) if canonicalize else F.coalesce(text, F.lit(""))
    return F.coalesce(*[F.when(t.rlike("(?iU)" + p), F.lit(p)) for p in INPUT_PATTERNS])


def filter_output(text: Column, min_entropy: float = 3.8, min_length: int = 12) -> Column:
    """struct(redacted, violations array, is_safe). Rules apply one after the other; spaced-out tokens of high entropy are found in the original text."""
    redacted, names = text, []
    for name, rule in OUTPUT_RULES.items():
        n = F.regexp_count(redacted, F.lit("(?iU)" + rule))
        names.append(F.when(n > 0, F.concat(F.lit(f"{name} x"), n)))
        redacted = F.regexp_replace(redacted, "(?iU)" + rule, "[REDACTED]")
    spaced = F.filter(F.regexp_extract_all(text, F.lit("(?U)" + SPACED_OUT), 0), lambda s: _is_secret(s, min_entropy, min_length))
    redacted = F.aggregate(spaced, redacted, lambda acc, s: F.replace(acc, s, F.lit("[REDACTED_SECRET]")))
    violations = F.concat(F.array_compact(F.array(*names)), F.transform(spaced, lambda s: F.lit("OBFUSCATED")))
    violations = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(violations)
    return F.struct(F.coalesce(redacted, F.lit("")).alias("redacted"), violations.alias("violations"), (F.size(violations) == 0).alias("is_safe"))


def _is_secret(fragment: Column, min_entropy: float, min_length: int) -> Column:
    plain = casefold(F.regexp_replace(fragment, r"(?U)[\s\-_.\\/]+", ""))
    return (F.length(plain) >= min_length) & (entropy(plain) >= min_entropy)


def outbound_payload(payload: Column, allowed: tuple[str, ...] | None = None) -> Column:
    """struct(payload, has_credential): a MAP<STRING,STRING> without restricted or, if given, not allowed keys, and whether any kept value looks like a credential."""
    kept = F.map_filter(payload, lambda k, v: ~F.lower(k).isin(*RESTRICTED_KEYS) & (k.isin(*allowed) if allowed is not None else F.lit(True)))
    return F.struct(kept.alias("payload"), F.coalesce(F.exists(F.map_values(kept), lambda v: F.coalesce(v.rlike("(?iU)" + CREDENTIAL), F.lit(False))), F.lit(False)).alias("has_credential"))


def egress_reason(url: Column, payload: Column, hosts: tuple[str, ...]) -> Column:
    """Why a request is denied: 'malformed', 'scheme', 'host' or 'payload'; null if it may go. Hosts compare in lower case."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    body = F.lower(F.coalesce(payload, F.lit("")))
    return (
        F.when(url.isNull() | scheme.isNull(), "malformed").when(scheme != "https", "scheme").when(host.isNull() | ~host.isin(*hosts), "host")
        .when(reduce(lambda a, b: a | b, [F.contains(body, F.lit(s)) for s in PAYLOAD_SIGNS]), "payload")
    )


def review_route(confidence: Column, is_high_risk: Column, auto: float, queue: float) -> Column:
    """'escalate' for high risk or a confidence below queue (or unknown), 'review' below auto, else 'auto'."""
    return F.when(F.coalesce(is_high_risk, F.lit(False)) | confidence.isNull() | (confidence < queue), "escalate").when(confidence < auto, "review").otherwise("auto")


def block_rates(decisions: DataFrame, blocked: Column, by: list[str], most: float = 0.4, least_calls: int = 5) -> DataFrame:
    """by, n_calls, n_blocked, block_rate, is_alert (more than ``most`` blocked of at least ``least_calls``)."""
    out = decisions.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.coalesce(blocked, F.lit(False))).alias("n_blocked"))
    rate = F.col("n_blocked") / F.col("n_calls")
    return out.withColumn("block_rate", F.round(rate, 6)).withColumn("is_alert", (F.col("n_calls") >= least_calls) & (rate > most))


def audit_pairs(events: DataFrame) -> DataFrame:
    """Starts and completions of requests, paired in order: request_id, user_id, started_at, completed_at, ms, blocked.

    events has request_id, kind ('start' or 'complete'), user_id, ts, blocked. Each
    start is consumed once; a completion without start belongs to 'anonymous' and has
    null ms; a start without completion gives no row. The n-th start of a request id
    meets its n-th completion.
    """
    w = Window.partitionBy("request_id", "kind").orderBy("ts")
    numbered = events.where(F.col("kind").isin("start", "complete") & F.col("request_id").isNotNull()).withColumn("_n", F.row_number().over(w))
    start = F.col("kind") == "start"
    return (
        numbered.groupBy("request_id", "_n")
        .agg(F.max(F.when(start, F.col("user_id"))).alias("user_id"), F.max(F.when(start, F.col("ts"))).alias("started_at"), F.max(F.when(~start, F.col("ts"))).alias("completed_at"), F.max(F.when(~start, F.col("blocked"))).alias("blocked"))
        .where(F.col("completed_at").isNotNull())
        .select("request_id", F.coalesce("user_id", F.lit("anonymous")).alias("user_id"), "started_at", "completed_at", ((F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1000).alias("ms"), "blocked")
    )
