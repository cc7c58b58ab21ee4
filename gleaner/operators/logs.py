"""Analytics over event logs: counts, budgets, retention, health and hash chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import digests


def keep_latest(events: DataFrame, n: int, order_col: str) -> DataFrame:
    """The n rows of greatest order_col: a top-k that each partition prunes first, not a sort of all."""
    return events.orderBy(F.desc(order_col)).limit(n)


def keep_latest_per_key(events: DataFrame, n: int, keys: list[str], order_col: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order_col))
    return events.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def keep_since(events: DataFrame, time_col: str, now: Column, days: int) -> DataFrame:
    return events.where(F.col(time_col) >= now - F.expr(f"interval {days} days"))


def usage_by_period(reservations: DataFrame, category_col: str = "category", units_col: str = "units", time_col: str = "ts") -> DataFrame:
    """(category, period, bucket, units): sums by UTC day and by month."""
    day = reservations.groupBy(F.col(category_col).alias("category"), F.lit("day").alias("period"), F.date_format(time_col, "yyyy-MM-dd").alias("bucket")).agg(F.sum(units_col).alias("units"))
    month = day.groupBy("category", F.lit("month").alias("period"), F.left("bucket", F.lit(7)).alias("bucket")).agg(F.sum("units").alias("units"))  # of the days, not the rows again
    return day.unionByName(month)


def used_now(reservations: DataFrame, now: Column, category_col: str = "category", units_col: str = "units", time_col: str = "ts") -> DataFrame:
    """(category, used_today, used_month)."""
    today = F.date_format(time_col, "yyyy-MM-dd") == F.date_format(now, "yyyy-MM-dd")
    month = F.date_format(time_col, "yyyy-MM") == F.date_format(now, "yyyy-MM")
    return reservations.where(month).groupBy(F.col(category_col).alias("category")).agg(F.coalesce(F.sum(F.when(today, F.col(units_col))), F.lit(0)).alias("used_today"), F.sum(units_col).alias("used_month"))


def least_recent_clients(requests: DataFrame, keep: int, keys: list[str], time_col: str) -> DataFrame:
    """Keys beyond the `keep` that were active last; ties by key. Only the last times are ordered, not the requests."""
    last = requests.groupBy(*keys).agg(F.max(time_col).alias("last"))
    newest = last.orderBy(F.desc("last"), *keys).limit(keep)
    return last.join(newest.select(*keys), keys, "left_anti")


def health(metrics: DataFrame, thresholds: dict[str, tuple[int, int]]) -> DataFrame:
    """metrics with status and reasons: critical ones first, then warnings, in the order of the thresholds."""
    severe = F.filter(F.array(*(F.when(F.col(c) >= high, F.lit(c)) for c, (_, high) in thresholds.items())), lambda x: x.isNotNull())
    mild = F.filter(F.array(*(F.when((F.col(c) >= low) & (F.col(c) < high), F.lit(c)) for c, (low, high) in thresholds.items())), lambda x: x.isNotNull())
    status = F.when(F.size(severe) > 0, "critical").when(F.size(mild) > 0, "warning").otherwise("healthy")
    return metrics.withColumns({"status": status, "reasons": F.concat(severe, mild)})


def transitions(statuses: DataFrame, keys: list[str], order_col: str, first: str = "healthy") -> DataFrame:
    """Rows whose status differs from the one before; the first is compared with `first`."""
    w = Window.partitionBy(*keys).orderBy(order_col)
    before = F.coalesce(F.lag("status").over(w), F.lit(first))
    return statuses.withColumn("previous_status", before).where("status <> previous_status")


def chain_breaks(events: DataFrame, keys: list[str], order_col: str = "sequence") -> DataFrame:
    """Rows whose previous_hash isn't the event_hash before them."""
    w = Window.partitionBy(*keys).orderBy(order_col)
    return events.withColumn("__before", F.lag("event_hash").over(w)).where(F.col("__before").isNotNull() & (F.col("previous_hash") != F.col("__before"))).drop("__before")


def event_digest(event: dict, previous_hash: str) -> str:
    """SHA-256 of an event's fields and the hash before it, as compact ASCII JSON in order of names."""
    return digests.digest(event | {"previous_hash": previous_hash}, compact=True, ascii_only=True)


def plain_values(row: dict) -> dict:
    """A pandas row's values as JSON has them: numbers of Python, null for what is missing, times as ISO texts."""
    out = {}
    for k, v in row.items():
        v = v.item() if hasattr(v, "item") else v
        out[k] = None if v is None or v != v else v.isoformat() if hasattr(v, "isoformat") else v
    return out


def chained(events: DataFrame, fields: list[str], keys: list[str], order_col: str = "sequence", start: str = "0" * 64, heads: DataFrame | None = None) -> DataFrame:
    """events with previous_hash and event_hash: each hash covers the event's `fields` and the hash before.

    A chain is serial by nature; chains of different keys are made side by side. A key's events come to one task in
    order and are read as a stream, of which the last hash is held. heads (keys, event_hash) are the last hashes of
    chains that go on; other keys begin with `start`.
    """
    columns = [*dict.fromkeys([*keys, order_col, *fields])]
    rows = events.select(*columns)
    if heads is None:
        rows = rows.withColumn("__start", F.lit(start))
    else:
        rows = rows.join(heads.select(*keys, F.col("event_hash").alias("__start")), keys, "left").select(*columns, F.coalesce("__start", F.lit(start)).alias("__start"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before = None, start
        for pdf in batches:
            hashes, befores = [], []
            for row in pdf.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != now:
                    now, before = key, row["__start"]
                befores.append(before)
                before = event_digest(plain_values({f: row[f] for f in fields}), before)
                hashes.append(before)
            yield pdf.drop(columns="__start").assign(previous_hash=befores, event_hash=hashes)

    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in columns)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, order_col)
    return dealt.mapInPandas(link, f"{schema}, previous_hash string, event_hash string")


def verified(events: DataFrame, fields: list[str], keys: list[str], order_col: str = "sequence") -> DataFrame:
    """events with intact: whether event_hash is the digest of the fields and previous_hash."""
    columns = [*dict.fromkeys([*keys, order_col, *fields])]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [event_digest(plain_values({f: r[f] for f in fields}), r["previous_hash"]) for r in pdf.to_dict("records")]
            yield pdf.assign(intact=pdf["event_hash"] == got)

    rows = events.select(*columns, "previous_hash", "event_hash")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.mapInPandas(check, f"{schema}, intact boolean")


def newest(rows: DataFrame, order_col: str, limit: int, low: int = 1, high: int = 100) -> DataFrame:
    """A page of the newest rows; a limit out of bounds is the nearest bound."""
    return rows.orderBy(F.desc(order_col)).limit(max(low, min(high, limit)))


def counts_by_kind(events: DataFrame, kind_col: str = "kind") -> DataFrame:
    """(kind, n, retained): events of each kind, and of all. One pass; the total is of the few counts."""
    by = events.groupBy(F.col(kind_col).alias("kind")).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("retained"))))  # one row


def fallback_rates(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, fallback_percent, provider_failures) of events (generation, model_calls array<struct<outcome>>).

    The percentage is rounded half up; a provider failure is a nested call whose outcome isn't ok.
    """
    failed = F.size(F.filter(F.coalesce("model_calls", F.array().cast("array<struct<outcome:string>>")), lambda c: ~c["outcome"].eqNullSafe("ok")))
    n = F.count("*")
    return events.groupBy(*keys).agg(n.alias("n"), F.floor(F.count_if(F.col("generation") == "fallback") * 100 / n + 0.5).alias("fallback_percent"), F.sum(failed).alias("provider_failures"))


def traffic_totals(counters: DataFrame) -> DataFrame:
    """One row (allowed, limited, failed): the counters (route, allowed, limited, failed) of all routes."""
    return counters.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("allowed", "limited", "failed")))


def arrivals_in_window(events: DataFrame, keys: list[str], time_col: str, window_s: float) -> DataFrame:
    """events with arrivals and first_us: how many of a key's events are in [t - window, t], and the first's microseconds."""
    us = F.unix_micros(F.col(time_col).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy("__us").rangeBetween(-int(window_s * 1e6), 0)
    return events.withColumn("__us", us).withColumns({"arrivals": F.count("*").over(w), "first_us": F.min("__us").over(w)}).drop("__us")


def active_in_window(events: DataFrame, group_col: str, client_col: str, time_col: str, now: Column, window_s: float) -> DataFrame:
    """(group, active_clients): distinct clients of each group in (now - window, now]."""
    recent = events.where((F.unix_micros(F.col(time_col).cast("timestamp")) > F.unix_micros(now) - int(window_s * 1e6)) & (F.col(time_col).cast("timestamp") <= now))
    return recent.groupBy(F.col(group_col).alias("group")).agg(F.countDistinct(client_col).alias("active_clients"))


def distinct_groups(events: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n_groups)."""
    return events.select(*columns).distinct().agg(F.count("*").alias("n_groups"))


#: Values an audit row may have, fixed values.
SAFE_VALUE, ROLES, OUTCOMES = r"^[A-Za-z0-9_.:@/-]{1,120}$", ("viewer", "editor", "administrator", "unauthenticated"), ("success", "rejected", "error")


def audit_values(events: DataFrame) -> DataFrame:
    """events with actor, role, action, outcome, status, target_type and target_id as an audit log takes them: what isn't safe or known becomes a default."""
    safe = lambda c, default: F.when(F.col(c).rlike(SAFE_VALUE), F.col(c)).otherwise(F.lit(default))
    return events.withColumns(
        {
            "actor": safe("actor", "unknown"),
            "role": F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("unauthenticated"),
            "action": safe("action", "unknown"),
            "outcome": F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("error"),
            "status": F.when(F.col("status").between(100, 599), F.col("status")).otherwise(500),
            "target_type": safe("target_type", None),
            "target_id": safe("target_id", None),
        }
    )


def payload_text(columns: list[str]) -> Column:
    """An event's payload as JSON, absent fields left out."""
    return F.to_json(F.struct(*columns))


def payload_fields(payload: Column, schema: str) -> Column:
    """The fields of a payload, null where it has none or is no JSON."""
    return F.from_json(payload, schema)
