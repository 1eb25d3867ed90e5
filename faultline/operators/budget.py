"""Budgets and ordered state over recorded calls. Running sums are scans over ranges of a run's order (scan.py), so one run may hold any number of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import n_words
from .scan import scanned, with_first


def review_cutoff(rows: DataFrame, keys: list[str], seq: str, words: str, found: str | None = None, max_calls: int = 20, max_findings: int = 50, max_tokens: int = 32000) -> DataFrame:
    """rows with estimate, calls_before, findings_before, used_before, `stop_reason` and `status`.

    A unit runs while no earlier one was stopped. It is stopped if calls or findings have reached their limit, or its estimate (1.3 a word) would pass the token
    budget; used tokens grow by the whole part of twice the estimate. The unit that breaks the token budget still gives its offline result (status 'offline')."""
    rows = rows.withColumn("estimate", F.col(words) * F.lit(1.3))
    used = (F.col("estimate") * 2).cast("bigint")
    sums = {"used_before": used} | ({"findings_before": F.col(found).cast("bigint")} if found else {})
    rows = scanned(rows, keys, [seq], sums, place="_place", part="_range").withColumn("calls_before", F.col("_place") - 1)
    rows = rows if found else rows.withColumn("findings_before", F.lit(0))
    reason = (
        F.when(F.col("calls_before") >= max_calls, "calls").when(F.col("findings_before") >= max_findings, "findings").when(F.col("used_before") + F.col("estimate") > max_tokens, "tokens")
    )
    rows = with_first(rows.withColumn("_r", reason), keys, "_place", "_range", F.col("_r").isNotNull(), F.col("_r"), "_stop")
    status = F.when(F.col("_place") > F.col("_stop.at"), "skipped").when(F.col("_r") == "tokens", "offline").when(F.col("_r").isNotNull(), "stopped").otherwise("run")
    return rows.withColumn("stop_reason", F.when(F.col("_place") >= F.col("_stop.at"), F.col("_stop.value"))).withColumn("status", status).drop("_r", "_stop", "_place", "_range")


def with_words(rows: DataFrame, prompt: str) -> DataFrame:
    return rows.withColumn("words", n_words(F.col(prompt)))


def patch_budget(rows: DataFrame, keys: list[str], seq: str, tokens: str, patched: str | None = None, max_tokens: int = 100_000, max_patches: int = 25) -> DataFrame:
    """rows with used_before, patches_before and `allowed`: the budget is tested before a call with what earlier calls used, and a refused
    call uses nothing."""
    sums = {"used_before": F.col(tokens)} | ({"patches_before": F.col(patched).cast("bigint")} if patched else {})
    rows = scanned(rows, keys, [seq], sums, place="_place").drop("_place")
    rows = rows if patched else rows.withColumn("patches_before", F.lit(0))
    return rows.withColumn("allowed", (F.col("used_before") < max_tokens) & (F.col("patches_before") < max_patches))


def first_success(attempts: DataFrame, keys: list[str], attempt: str, parsed: str, max_attempts: int = 3, max_calls: int = 5, value: str | None = None) -> DataFrame:
    """For each key: the first parsed attempt within the limits, how many were made until then, and whether it succeeded."""
    limit = min(max_attempts, max_calls)
    seen = attempts.where(F.col(attempt) <= limit)
    ok = F.when(F.col(parsed), F.col(attempt))
    out = seen.groupBy(*keys).agg(F.min(ok).alias("first_ok"), F.count("*").alias("n_recorded"), *([F.min_by(value, ok).alias("best")] if value else []))
    out = out.withColumn("success", F.col("first_ok").isNotNull())
    return out.withColumn("attempts_made", F.coalesce(F.col("first_ok").cast("bigint"), "n_recorded")).drop("n_recorded")


def failure_streaks(rows: DataFrame, keys: list[str], seq: str, ok: str, limit: int = 3) -> DataFrame:
    """rows with `streak` (failures in a row up to here, 0 after a success) and `stopped` (an earlier row or this one reached the limit)."""
    rows = scanned(rows, keys, [seq], last={"_ok": F.col(ok)}, place="_place", part="_range").withColumn("streak", F.col("_place") - F.col("_ok"))
    rows = with_first(rows, keys, "_place", "_range", F.col("streak") >= limit, F.col("streak"), "_stop")
    return rows.withColumn("stopped", F.coalesce(F.col("_place") >= F.col("_stop.at"), F.lit(False))).drop("_ok", "_place", "_stop", "_range")


def last_good(rows: DataFrame, keys: list[str], seq: str, good: str, value: str) -> DataFrame:
    """The value of the last good row of each key, or null where there is none."""
    return rows.groupBy(*keys).agg(F.max_by(F.when(F.col(good), F.col(value)), F.when(F.col(good), F.col(seq))).alias("last_good"))


def changed(rows: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """rows with `changed`: the value differs from the row before, or there is none before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(seq))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(seq)) == 1
    return rows.withColumn("changed", first | ~before.eqNullSafe(F.col(value)))


def timings(rows: DataFrame, keys: list[str], ts: str, order: list[str]) -> DataFrame:
    """rows with `seconds` until the next row of their keys, null for the last."""
    after = F.lead(ts).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("seconds", (F.unix_micros(after) - F.unix_micros(ts)) / 1e6)
