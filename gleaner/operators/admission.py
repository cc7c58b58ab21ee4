"""Stateful admission as ordered folds within a key: only what is admitted counts.

A key's events reach one task in order and are read as a stream: a task holds the state of one key, which the limit
bounds, and a batch of rows. What a fold decides depends on all that it admitted before, so one key's events are one
sequence. A key of many events is cut into pieces, which tasks sort and read one after the other; its state goes from
piece to piece as a row. So time is linear in the events, and a task's memory has a bound however many a key has.
`gleaner.streaming.stateful` has the same decisions on streams.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from itertools import repeat
from math import ceil
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.storage import cut, remove, work_folder

Start = Callable[[], Any]
Decide = Callable[[Any, tuple], tuple]
#: Rows of one key that a task sorts at once: a fixed value.
PIECE = 1 << 20


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Start, decide: Decide, out: str) -> DataFrame:
    """rows with the columns `out` (DDL) added, which a fold over each key's rows in order gives.

    start() gives a key's first state, which can be pickled; decide(state, values) changes it and returns the added
    values of a row, whose values are in the order of the columns. Rows of equal keys and order come in any order.
    """
    columns = rows.columns
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    spots = [columns.index(k) for k in keys]
    names = [part.split()[0] for part in out.split(", ")]
    arrow = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    types = [arrow[part.split()[1]] for part in out.split(", ")]

    def listed(column: pa.Array) -> list:
        """A column as Python values; numbers without nulls in one step."""
        plain = column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
        return column.to_numpy().tolist() if plain else column.to_pylist()

    def left(row: pa.RecordBatch, state: Any) -> list[pa.RecordBatch]:
        """The state as a row, if the key goes on in another piece; row is the last that was read."""
        if not row.column(len(columns) + 1)[0].as_py():
            return []
        said = [*row.columns[: len(columns)], *(pa.nulls(1, kind) for kind in types), pa.array([pickle.dumps(state)], pa.binary())]
        return [pa.RecordBatch.from_arrays(said, [*columns, *names, "__state"])]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, past, carried = None, start(), None, False
        for batch in batches:
            carried = batch.num_columns > len(columns)
            states = carried and batch.column(len(columns)).null_count < batch.num_rows
            given = batch.column(len(columns)).to_pylist() if states else repeat(None)
            lists = [listed(batch.column(k)) for k in range(len(columns))]
            made = []
            for i, (before, key, values) in enumerate(zip(given, zip(*(lists[k] for k in spots)) if spots else repeat(()), zip(*lists))):
                if key != now:
                    ended = batch.slice(i - 1, 1) if i else past
                    if carried and ended is not None:
                        yield from left(ended, state)
                    now, state = key, start()
                if before is not None:
                    state = pickle.loads(before)
                else:
                    made.append(decide(state, values))
            past = batch.slice(batch.num_rows - 1, 1) if batch.num_rows else past
            own = (batch.filter(batch.column(len(columns)).is_null()) if states else batch).columns[: len(columns)]
            added = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*own, *added, *([pa.nulls(len(made), pa.binary())] if carried else [])], [*columns, *names, *(["__state"] if carried else [])])
        if carried and past is not None:
            yield from left(past, state)

    deal = lambda df: df.repartition(*keys) if keys else df.repartition(1)
    total = rows.groupBy(*keys).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (total.most or 0) <= PIECE:
        return deal(rows).sortWithinPartitions(*keys, *order).mapInArrow(fold, f"{kinds}, {out}")

    spark = rows.sparkSession
    folder = work_folder(spark)
    # pieces are ranges of keys and order, so a key is in pieces that follow each other
    rows.repartitionByRange(total.all // PIECE + 1, *keys, *order).withColumn("__piece", F.spark_partition_id()).write.partitionBy("__piece").parquet(f"{folder}/pieces")
    placed = spark.read.schema(f"{kinds}, __piece int").parquet(f"{folder}/pieces")
    spans = placed.groupBy(*keys).agg(F.min("__piece").alias("__lo"), F.max("__piece").alias("__hi")).where("__lo < __hi")
    spans = cut(spans.select(*(F.col(k).alias(f"__{k}") for k in keys), "__lo", "__hi"))  # less rows than pieces
    rounds = spans.agg(F.max(F.col("__hi") - F.col("__lo"))).first()[0] or 0
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    for k in range(rounds + 1):
        if k == 0:
            read = placed
        else:  # the pieces in which a key goes on
            read = placed.where(F.col("__piece").isin([r[0] for r in spans.where(f"__lo + {k} <= __hi").select(F.col("__lo") + k).distinct().collect()]))
        met = read.join(F.broadcast(spans), same, "left" if k == 0 else "inner").where(F.col("__piece") == F.coalesce(F.col("__lo") + k, F.col("__piece")))
        part = met.select(*columns, F.lit(None).cast("binary").alias("__state"), F.coalesce(F.col("__piece") < F.col("__hi"), F.lit(False)).alias("__more"))
        if k:
            part = part.unionByName(states.withColumn("__more", F.lit(True)), allowMissingColumns=True)
        made = deal(part).sortWithinPartitions(*keys, F.col("__state").isNull(), *order).mapInArrow(fold, f"{kinds}, {out}, __state binary")
        made.write.parquet(f"{folder}/made/__round={k}")
        states = spark.read.schema(made.schema).parquet(f"{folder}/made/__round={k}").where("__state IS NOT NULL").select(*keys, "__state")
    remove(spark, f"{folder}/pieces")
    return spark.read.schema(made.schema).parquet(f"{folder}/made").where("__state IS NULL").select(*columns, *names)


def _seconds(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def sliding_admission(requests: DataFrame, keys: list[str], time_col: str, id_col: str, limit: int, window_s: float) -> DataFrame:
    """(keys, id, ts, admitted, retry_after): at most `limit` admitted requests in (now - window, now].

    Refused requests use nothing up. A request of `window_s` ago no longer counts. ts is seconds; retry_after is the
    seconds until the oldest admitted request expires, 1 at least, 0 if admitted. Ties in time come by id; a request
    without a time is admitted and not counted.
    """

    def decide(live: deque, values: tuple) -> tuple:
        at = values[-1]
        if at is None:
            return True, 0
        while live and live[0] <= at - window_s:
            live.popleft()
        if len(live) < limit:
            live.append(at)
            return True, 0
        return False, max(1, ceil(live[0] + window_s - at)) if live else 1

    rows = requests.select(*keys, F.col(id_col).alias("id"), _seconds(time_col).alias("ts"))
    return ordered_fold(rows, keys, ["ts", "id"], deque, decide, "admitted boolean, retry_after int")


def recent_client_admission(requests: DataFrame, client_col: str, time_col: str, id_col: str, limit: int, window_s: float, clients: int = 10_000) -> DataFrame:
    """(client, id, ts, admitted): sliding_admission() of a server that remembers only the `clients` that asked last.

    A client that fell out of memory starts anew. Which client falls out depends on all requests before, so they are
    one sequence, which one task at a time reads in order; it holds `clients` times `limit` times at most.
    """

    def decide(known: OrderedDict, values: tuple) -> tuple:
        client, _, at = values
        if at is None:
            return (True,)
        live = known.pop(client, None) or deque()
        while live and live[0] <= at - window_s:
            live.popleft()
        free = len(live) < limit
        if free:
            live.append(at)
        known[client] = live
        if len(known) > clients:
            known.popitem(last=False)
        return (free,)

    rows = requests.select(F.col(client_col).alias("client"), F.col(id_col).alias("id"), _seconds(time_col).alias("ts"))
    return ordered_fold(rows, [], ["ts", "id"], OrderedDict, decide, "admitted boolean")


def reserve_budget(requests: DataFrame, category_col: str, time_col: str, units_col: str, id_col: str, daily: int, monthly: int) -> DataFrame:
    """(category, id, day, units, admitted): a request is admitted whole if it fits into the day's and the month's rest.

    A month's budget starts anew, so a category's months are separate folds. A request without a time or units isn't admitted.
    """

    def start() -> dict:
        return {"day": None, "today": 0, "month": 0}

    def decide(used: dict, values: tuple) -> tuple:
        day, units = values[-2:]
        if day is None or units is None:
            return (False,)
        if day != used["day"]:
            used["day"], used["today"] = day, 0
        fits = used["today"] + units <= daily and used["month"] + units <= monthly
        if fits:
            used["today"] += units
            used["month"] += units
        return (fits,)

    ts = F.col(time_col).cast("timestamp")
    rows = requests.select(F.col(category_col).alias("category"), F.date_format(ts, "yyyy-MM").alias("month"), F.unix_micros(ts).alias("at"), F.col(id_col).alias("id"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.col(units_col).cast("long").alias("units"))
    return ordered_fold(rows, ["category", "month"], ["at", "id"], start, decide, "admitted boolean").select("category", "id", "day", "units", "admitted")


def first_by_key(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Idempotent create: (keys, the first request's id columns, repeats), from an aggregate alone."""
    return requests.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"), (F.count("*") - 1).alias("repeats")).select(*keys, "first.*", "repeats")


def own_slots(bookings: DataFrame) -> DataFrame:
    """bookings (booking_id, session_id, idempotency_key, slot_id, at) with outcome: created, repeated or slot_taken.

    A session's key creates one booking; a slot belongs to the first booking that asks for it.
    """
    first_of_key = bookings.groupBy("session_id", "idempotency_key").agg(F.min(F.struct("at", "booking_id")).alias("k"))
    fresh = bookings.join(first_of_key, ["session_id", "idempotency_key"]).withColumn("__new", F.col("k.booking_id") == F.col("booking_id"))
    owner = fresh.where("__new").groupBy("slot_id").agg(F.min(F.struct("at", "booking_id")).alias("o"))
    return fresh.join(owner, "slot_id", "left").select(
        *bookings.columns,
        F.when(~F.col("__new"), "repeated").when(F.col("o.booking_id") == F.col("booking_id"), "created").otherwise("slot_taken").alias("outcome"),
    )


def busy_stretches(rows: DataFrame, time_col: str, window_s: float) -> DataFrame:
    """rows with stretch (long): between rows of two stretches lies a whole window without any row.

    Times are cut into windows; a run of windows that have rows is a stretch. What is ordered is one number for each
    window that has rows, which the time span bounds, not the rows. Rows without a time have stretch null.
    """
    slot = F.floor(F.col(time_col) / window_s)
    used = rows.select(slot.alias("slot")).where("slot IS NOT NULL").distinct()
    w = Window.orderBy("slot")
    runs = used.withColumn("new", (F.col("slot") - F.coalesce(F.lag("slot").over(w), F.col("slot")) > 1).cast("long")).select("slot", F.sum("new").over(w).alias("stretch"))
    return rows.withColumn("slot", slot).join(runs, "slot", "left").drop("slot")


def login_throttle(attempts: DataFrame, per_peer: int = 5, overall: int = 100, window_s: float = 300.0) -> DataFrame:
    """(peer, id, ts, admitted, retry_after) of attempts (attempt_id, peer, at): refused if the peer has `per_peer` or all have `overall` admitted ones.

    Only admitted attempts in (at - window, at] count; ties in time come by id, and an attempt without a time is
    admitted and not counted. retry_after is as in `sliding_admission`, for the later of the limits that refuse. The
    limit over all peers ties each decision to the ones before it, but not across a quiet window: stretches are dealt
    to tasks, each of which reads its sorted attempts as a stream and holds `overall` admitted ones at most.
    """

    def start() -> tuple:
        return deque(), {}

    def decide(state: tuple, values: tuple) -> tuple:
        (live, held), peer, at = state, values[1], values[3]
        if at is None:
            return True, 0
        while live and live[0][1] <= at - window_s:
            gone = live.popleft()[0]
            held[gone].popleft()
            if not held[gone]:
                del held[gone]
        own = held.get(peer, ())
        full = ([own[0] if own else at] if len(own) >= per_peer else []) + ([live[0][1] if live else at] if len(live) >= overall else [])
        if full:
            return False, max(1, ceil(max(full) + window_s - at))
        live.append((peer, at))
        held.setdefault(peer, deque()).append(at)
        return True, 0

    rows = busy_stretches(attempts.select("peer", F.col("attempt_id").alias("id"), _seconds("at").alias("ts")), "ts", window_s)
    return ordered_fold(rows.select("stretch", "peer", "id", "ts"), ["stretch"], ["ts", "id"], start, decide, "admitted boolean, retry_after int").drop("stretch")


def last_turns(turns: DataFrame, keys: list[str], order_col: str, context_cols: list[str], n: int = 4) -> DataFrame:
    """The last n turns of each conversation after runs of equal contexts became one (its first turn)."""
    w = Window.partitionBy(*keys).orderBy(order_col)
    same = F.lit(True)
    for c in context_cols:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    starts = turns.withColumn("__same", same & (F.row_number().over(w) > 1)).where("NOT __same").drop("__same")
    latest = Window.partitionBy(*keys).orderBy(F.desc(order_col))
    return starts.withColumn("position", F.row_number().over(latest)).where(F.col("position") <= n)


def slots(days: DataFrame, contact_id: str, times: tuple[str, ...] = ("09:00", "13:30"), zone: str = "Europe/Stockholm", minutes: int = 30) -> DataFrame:
    """Calendar slots on the week days of `days` (day date): slot_id, contact_id, local start, starts_at and ends_at in UTC."""
    weekdays = days.where(F.weekday("day") < 5).select("day", F.explode(F.array(*map(F.lit, times))).alias("time"))
    local = F.to_timestamp(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" "), "time"), "yyyy-MM-dd HH:mm")
    start = F.to_utc_timestamp(local, zone)
    stamp = F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    slot = F.concat(F.lit("slot-"), F.left(F.sha2(F.concat_ws("|", F.lit(contact_id), stamp), 256), F.lit(16)))
    return weekdays.select(slot.alias("slot_id"), F.lit(contact_id).alias("contact_id"), F.date_format(local, "yyyy-MM-dd HH:mm").alias("local_start"), start.alias("starts_at"), (start + F.expr(f"interval {minutes} minutes")).alias("ends_at"))


def week_bounds(weeks: DataFrame, day_col: str, zone: str = "Europe/Stockholm") -> DataFrame:
    """weeks with is_monday, and for Mondays week_start and week_end: the UTC times at which the local week begins and ends.

    Across a change of clocks a week has an hour more or less. Other days have null bounds: a week begins on a Monday.
    """
    day = F.col(day_col).cast("date")
    monday = F.weekday(day) == 0
    bound = lambda n: F.when(monday, F.to_utc_timestamp(F.date_add(day, n).cast("timestamp"), zone))
    return weeks.withColumns({"is_monday": monday, "week_start": bound(0), "week_end": bound(7)})


def free_slots(slots: DataFrame, bookings: DataFrame, key: str = "slot_id") -> DataFrame:
    """Slots that no confirmed booking has; bookings (key, status)."""
    return slots.join(bookings.where("status = 'confirmed'").select(key), key, "left_anti")


#: Longest values of a booking's fields, in the order in which they are checked: fixed values.
FIELD_LIMITS = {"visitor_name": 100, "visitor_email": 254, "company_name": 120, "meeting_topic": 300}


def booking_fault(contacts: tuple[str, ...], languages: tuple[str, ...] = ("sv", "en")) -> Column:
    """Why a booking (session_id, idempotency_key, contact_id, preferred_language, consent and the fields) is refused; null if it isn't."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = (
        F.when(~text("session_id").rlike(r"^[A-Za-z0-9_-]{1,100}$"), "invalid_session")
        .when(~F.length(text("idempotency_key")).between(1, 100), "invalid_idempotency_key")
        .when(~text("contact_id").isin(*contacts), "invalid_contact")
        .when(~text("preferred_language").isin(*languages), "invalid_language")
        .when(~F.coalesce(F.col("consent"), F.lit(False)), "missing_consent")
    )
    for field, most in FIELD_LIMITS.items():
        if field != "company_name":
            out = out.when(F.trim(text(field)) == "", "missing_field")
        out = out.when(F.length(text(field)) > most, "field_too_long")
    return out.when(~text("visitor_email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "invalid_email")


def public_bookings(bookings: DataFrame, topic_chars: int = 100) -> DataFrame:
    """Bookings without the columns that name a session, their topics cut to `topic_chars` characters."""
    shown = bookings.drop("session_id", "idempotency_key")
    return shown.withColumn("meeting_topic", F.left("meeting_topic", F.lit(topic_chars))) if "meeting_topic" in shown.columns else shown


def calendar_view(bookings: DataFrame, contact_id: str, start: Column, end: Column) -> DataFrame:
    """Confirmed bookings of a contact with start <= starts_at < end, by time: what a calendar may show of them."""
    own = bookings.where((F.col("contact_id") == contact_id) & (F.col("status") == "confirmed") & (F.col("starts_at") >= start) & (F.col("starts_at") < end))
    return own.select("booking_id", "contact_id", "slot_id", "starts_at", F.left("meeting_topic", F.lit(100)).alias("meeting_topic"), "status").orderBy("starts_at", "booking_id")


def rescheduled(bookings: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bookings after the moves, outcomes) of moves (move_id, booking_id, session_id, slot_id, contact_id, starts_at, at).

    A move is of the session's own booking (else not_found), a confirmed one (else invalid_state), with the same
    contact (else invalid_contact), to a slot that no other confirmed booking has and that no earlier move of the
    batch asks for (else slot_unavailable). Of several moves of a booking the first valid one counts; the others are
    superseded. Slots that moves leave become free only for the next batch.
    """
    held = bookings.select("booking_id", F.col("session_id").alias("__s"), F.col("status").alias("__st"), F.col("contact_id").alias("__c"), F.col("slot_id").alias("__old"))
    m = moves.join(held, "booking_id", "left")
    fault = F.when(F.col("__s").isNull() | (F.col("__s") != F.col("session_id")), "not_found").when(F.col("__st") != "confirmed", "invalid_state").when(F.col("__c") != F.col("contact_id"), "invalid_contact")
    taken = bookings.where("status = 'confirmed'").groupBy("slot_id").agg(F.first("booking_id").alias("__owner"))
    m = m.withColumn("fault", fault).join(taken, "slot_id", "left")
    m = m.withColumn("fault", F.coalesce("fault", F.when(F.col("__owner").isNotNull() & (F.col("__owner") != F.col("booking_id")), "slot_unavailable")))
    first = m.where("fault IS NULL").groupBy("slot_id").agg(F.min(F.struct("at", "move_id")).alias("__first"))
    m = m.join(first, "slot_id", "left").withColumn("fault", F.coalesce("fault", F.when(F.col("__first.move_id") != F.col("move_id"), "slot_unavailable")))
    own = m.where("fault IS NULL").groupBy("booking_id").agg(F.min(F.struct("at", "move_id")).alias("__own"))
    m = m.join(own, "booking_id", "left").withColumn("fault", F.coalesce("fault", F.when(F.col("__own.move_id") != F.col("move_id"), "superseded")))
    done = m.where("fault IS NULL").select("booking_id", F.col("slot_id").alias("__slot"), F.col("starts_at").alias("__at"))
    after = bookings.join(done, "booking_id", "left").withColumns({"slot_id": F.coalesce("__slot", "slot_id"), "starts_at": F.coalesce("__at", "starts_at")}).select(*bookings.columns)
    return after, m.select("move_id", "booking_id", F.coalesce("fault", F.lit("moved")).alias("outcome"))


def cancelled(bookings: DataFrame, requests: DataFrame) -> DataFrame:
    """bookings with status `cancelled` where a request (booking_id, session_id) of the same session asks for it."""
    asked = requests.select("booking_id", "session_id").distinct().withColumn("__c", F.lit(True))
    return bookings.join(asked, ["booking_id", "session_id"], "left").withColumn("status", F.when(F.col("__c"), "cancelled").otherwise(F.col("status"))).select(*bookings.columns)
