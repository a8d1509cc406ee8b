"""Column functions on probabilities, labels, times and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def sign(label: Column) -> Column:
    return F.when(label == "positive", 1).when(label == "negative", -1).otherwise(0)


def top_label(negative: Column, neutral: Column, positive: Column) -> Column:
    """Label of the largest probability; the first wins ties."""
    return F.when((negative >= neutral) & (negative >= positive), "negative").when(neutral >= positive, "neutral").otherwise("positive")


def index_label(score: Column) -> Column:
    return F.when(score > C.LABEL_THRESHOLD, "positive").when(score < -C.LABEL_THRESHOLD, "negative").otherwise("neutral")


def one_hot(label: Column) -> list[Column]:
    return [F.when(label == name, 1.0).otherwise(0.0).alias(f"p_{name}") for name in C.LABELS]


def session_open(session: Column) -> Column:
    return session.cast("timestamp") + F.expr(f"INTERVAL {C.OPEN_UTC_HOUR} HOUR")


def level(today_n: Column, z: Column) -> Column:
    return F.when(z.isNull(), "insufficient").when(z < C.HIGH_Z, "high").when(z < C.WATCH_Z, "watch").otherwise("normal")


def level_rank(level_: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, C.LEVELS)), level_) - 1


def time_bucket(at: Column, seconds: int = C.CACHE_SECONDS) -> Column:
    return F.floor(F.unix_timestamp(at) / seconds).cast("long")


def origin(day: Column, now: Column, hours: int = 48) -> Column:
    """``live`` if no more than ``hours`` have gone since the day's end, else ``backfill``."""
    end = F.date_add(day, 1).cast("timestamp")
    return F.when(F.timestamp_diff("SECOND", end, now) <= hours * 3600, "live").otherwise("backfill")


def utc_strict(raw: Column) -> Column:
    """ISO text with an offset; text without one is an error."""
    aware = raw.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(aware, F.to_timestamp(raw)).when(raw.isNotNull(), F.raise_error(F.concat(F.lit("naive time: "), raw)))


def utc_lenient(raw: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.trim(raw), F.lit("")))


def lag_hours(published: Column, fetched: Column, created: Column) -> Column:
    return F.timestamp_diff("SECOND", published, F.coalesce(fetched, created)) / 3600


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = F.try_divide(k, n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) by running terms; log-space start keeps small terms. At p 0 and 1 all draws are alike."""
    q = F.when((p > 0) & (p < 1), p).otherwise(0.5)  # a stand-in where no sum is needed
    start = F.struct((n * F.log(1 - q)).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: F.struct(
        (acc["term"] + F.log((n - i) / (i + 1)) + F.log(q / (1 - q))).alias("term"), (acc["sum"] + F.when(i >= k, F.exp(acc["term"])).otherwise(0.0)).alias("sum")
    )
    body = F.aggregate(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")), start, step)
    tail = body["sum"] + F.when(k <= n, F.exp(body["term"])).otherwise(0.0)
    sure = F.when(k <= 0, 1.0).when(k > n, 0.0).when(p <= 0, 0.0).when(p >= 1, 1.0)
    return F.coalesce(F.when(p.isNotNull(), sure), F.when(p.isNotNull(), tail))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of the discordant counts."""
    n, low = (b + c).cast("long"), F.least(b, c).cast("long")
    tail = F.lit(1.0) - binomial_tail(low + 1, n, F.lit(0.5))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def kappa(agreed: Column, expected: Column, when_certain: Column) -> Column:
    """Cohen's kappa from observed and expected agreement; ``when_certain`` is its value where expectation is one."""
    return F.when(expected < 1, (agreed - expected) / F.nullif(1 - expected, F.lit(0.0))).otherwise(when_certain)


def softmax(*logits: Column) -> list[Column]:
    """Probabilities of logits, shifted by the largest."""
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def aligned(found: Column) -> list[Column]:
    """Probabilities of the three labels from a map by label; a label it lacks has 0."""
    return [F.coalesce(F.try_element_at(found, F.lit(x)), F.lit(0.0)) for x in C.LABELS]


def scale_position(label: Column, confidence: Column) -> Column:
    """Place on a scale from 0 to 100 percent: the label's sign times the confidence, within -1 and 1."""
    sign = F.when(label == "negative", -1.0).when(label == "positive", 1.0).otherwise(0.0)
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sign * confidence)) + 1) * 50


def switch_verdict(kappa_: Column, coverage: Column, pairs: Column) -> Column:
    return (
        F.when(pairs < C.MIN_PAIRS, "no conclusion: pairs").when(coverage < C.MIN_COVERAGE, "no conclusion: coverage").when(kappa_ >= C.KAPPA_ADOPT, "adopt").when(kappa_ >= C.KAPPA_DISCLOSE, "adopt and disclose").otherwise("pause")
    )
