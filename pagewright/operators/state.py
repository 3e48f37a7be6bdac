"""State tables: upserts, histories, deltas, jobs, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by ``order``; aggregated map-side, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[Column], keep_null: bool = True) -> DataFrame:
    """``target`` with the last update of every key; with ``keep_null`` false a null leaves the old value."""
    new = latest(updates, keys, order).select(*target.columns)
    if keep_null:
        return target.join(new, keys, "left_anti").unionByName(new)
    old, got = target.alias("o"), new.alias("n")
    cols = [c for c in target.columns if c not in keys]
    return old.join(got, keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in cols])


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet are added; the first writer wins."""
    return target.unionByName(rows.dropDuplicates(keys).join(target, keys, "left_anti").select(*target.columns))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns replaced in the rows that meet the condition (null counts as no)."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def needing(source: DataFrame, done: DataFrame, key: str, stamp: str, done_stamp: str) -> DataFrame:
    """Rows never done or changed since."""
    return source.join(done.select(F.col(key), F.col(done_stamp).alias("_done")), key, "left").where(F.col("_done").isNull() | (F.col(stamp) > F.col("_done"))).drop("_done")


def index_action(in_table: Column, stored: Column, disk: Column, since: Column, unusable: Column) -> Column:
    """'new', 'reingest' or 'skip' of a file by what is indexed of it."""
    stale = F.when(stored == 0, F.coalesce(disk > since, F.lit(False))).otherwise(disk > stored)
    return F.when(~in_table, F.when(unusable & stored.isNotNull() & ~stale, "skip").otherwise("new")).when(stored.isNull() | stale, "reingest").otherwise("skip")


# From which states a job may go where.
TRANSITIONS = {
    "running": ("queued",),
    "cancel_requested": ("queued", "running"),
    "succeeded": ("running",),
    "failed": ("queued", "running"),
    "cancelled": ("queued", "running", "cancel_requested"),
    "interrupted": ("queued", "running", "cancel_requested"),
}
ACTIVE = ("queued", "running", "cancel_requested")


def may_become(state: Column, to: Column) -> Column:
    """Whether a job may go from one state to another."""
    out = F.lit(False)
    for target, sources in TRANSITIONS.items():
        out = out | ((to == target) & state.isin(*sources))
    return out


def stale_jobs(jobs: DataFrame, now: Column, heartbeat_s: int = 15, queued_s: int = 60) -> DataFrame:
    """Active jobs without a sign of life: running ones after 15 s, queued ones after a minute."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_seen")
    return jobs.where(F.col("status").isin(*ACTIVE) & F.when(F.col("status") == "queued", age > queued_s).otherwise(age > heartbeat_s))


def usage_totals(events: DataFrame, key: str, cost: str, counts: list[str]) -> DataFrame:
    """Calls, sums and cost per profile; the cost is partial as soon as one is missing."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counts], F.round(F.sum(F.coalesce(F.col(cost), F.lit(0.0))), 4).alias("cost"), F.max(F.col(cost).isNull().cast("int")).alias("cost_partial"))


def cost_usd(inputs: Column, cached: Column, outputs: Column, p_in: float, p_out: float, p_cache: float | None = None) -> Column:
    """Cost of a call in dollars by prices per million; cached inputs are part of all inputs and never more."""
    hit = F.least(cached, inputs)
    return ((inputs - hit) * p_in + hit * (p_in if p_cache is None else p_cache) + outputs * p_out) / 1_000_000


def sum_or_null(c: Column) -> Column:
    """A sum that is null as soon as one value is."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def inherited_level(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Log lines with ``level``, which lines without one have from the last line with one."""
    own = F.nullif(F.regexp_extract(F.col(text), r"\b(DEBUG|INFO|WARNING|ERROR)\b", 1), F.lit(""))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("level", F.last(own, ignorenulls=True).over(w))


def log_lines(lines: DataFrame, group: str, order: str, text: str, levels: list[str], query: str = "") -> DataFrame:
    """Log lines of some levels (those without one have the level of the line before) that hold a text, whatever its case."""
    kept = inherited_level(lines, group, order, text).where(F.col("level").isin(*levels))
    return kept.where(F.lower(text).contains(query.lower())) if query else kept


def archived(history: DataFrame, current: DataFrame, keys: DataFrame, on: list[str], reason: str) -> DataFrame:
    """The history with the current rows of the given keys added, before they are overwritten."""
    return history.unionByName(current.join(keys, on, "left_semi").withColumn("reason", F.lit(reason)).select(*history.columns))


def reset_orphans(decisions: DataFrame, valid: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Decisions that still have their item, and rows for the history of those that don't."""
    return decisions.join(valid, key, "left_semi"), decisions.join(valid, key, "left_anti").withColumn("action", F.lit("reset"))


# Notes of failed downloads that may be tried again.
RETRYABLE = ("failed:html-response", "failed:403")


def failure_note(status: Column) -> Column:
    """The note of a failed download: lasting for client errors, none for those that may pass."""
    return F.when(status.between(400, 499) & ~status.isin(408, 429), F.concat(F.lit("failed:"), status.cast("string")))


def clamp(value: int | None, least: int, most: int, default: int) -> int:
    """An argument within its limits; the default for none or nonsense."""
    try:
        return max(least, min(most, int(value)))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
