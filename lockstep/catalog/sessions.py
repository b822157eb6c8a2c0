"""Calendar, session and event-date queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.catalog import register
from lockstep.operators import calendar_ops as cal
from lockstep.operators import events as ev
from lockstep.sources.calendar import split_by_horizon
from lockstep.sources.warehouse import Warehouse


def order_days(w: Warehouse):
    return w.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@register("a1_session_calendar", """
 SELECT o_orderkey, day, is_session, ix, next_ix, prev_ix FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) JOIN cal USING (day)""")
def session_calendar(w):
    df = cal.with_session_index(order_days(w), "day", "")
    return df.withColumn("is_session", F.col("ix").isNotNull())


@register("a3_quarters", """
 SELECT o_custkey, year(q) AS year, quarter(q) AS quarter FROM (
  SELECT o_custkey, unnest(generate_series(date_trunc('quarter', min(o_orderdate)), max(o_orderdate), INTERVAL 3 MONTH)) AS q FROM orders GROUP BY 1)""")
def quarters(w):
    spans = w.table("orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return cal.quarters_between(spans, "start", "end").drop("start", "end")


@register("d1_is_session", """
 SELECT day, is_session, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders) JOIN cal USING (day) GROUP BY ALL""")
def is_session(w):
    days = order_days(w).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return cal.is_session(days, "day")


@register("d2_session_on_or_after", """
 SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, (SELECT min(session) FROM ses WHERE session >= CAST(o_orderdate AS DATE)) AS session FROM orders""")
def on_or_after(w):
    return cal.session_on_or_after(order_days(w), "day", "session")


@register("d3_session_on_or_before", """
 SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, (SELECT max(session) FROM ses WHERE session <= CAST(o_orderdate AS DATE)) AS session FROM orders""")
def on_or_before(w):
    return cal.session_on_or_before(order_days(w), "day", "session")


@register("d4_session_offset", """
 SELECT o_orderkey, day, s.session AS back_20 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
 JOIN cal USING (day) JOIN ses s ON s.ix = cal.ix - 20""")
def offset(w):
    df = cal.is_session(order_days(w), "day").where("is_session").drop("is_session")
    return cal.session_offset(df, "day", -20, "back_20")


@register("d5_sessions_in_range", """
 SELECT l_orderkey, count(*) AS sessions, min(session) AS first_session, max(session) AS last_session FROM (
  SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem GROUP BY 1)
 JOIN ses ON session BETWEEN a AND b GROUP BY 1""")
def in_range(w):
    spans = w.table("lineitem").groupBy("l_orderkey").agg(
        F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    return cal.sessions_in_range(spans, "a", "b").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("session").alias("first_session"),
        F.max("session").alias("last_session"))


@register("d6_event_session", """
 SELECT lockup_id, event_date, s.session AS event_session, 'XNYS' AS calendar_id FROM lock
 JOIN cal ON day = event_date JOIN ses s ON s.ix = next_ix""")
def event_session(w):
    dated = ev.with_event_date(w.lockups()).where("event_date is not null").select("lockup_id", "event_date")
    return cal.resolve_event_session(dated).select("lockup_id", "event_date", "event_session", "calendar_id")


@register("d7_observation_session", """
 SELECT lockup_id, k AS observation_offset, s.session AS observation_session FROM lock JOIN cal ON day = event_date,
 (SELECT unnest([-60,-40,-20,-10,-5,-1]) AS k) JOIN ses s ON s.ix = next_ix + k""")
def observation_session(w):
    grid = ev.with_event_date(w.lockups()).where("event_date is not null").select(
        "lockup_id", "event_date", F.explode(F.array(*[F.lit(k) for k in (-60, -40, -20, -10, -5, -1)]))
        .alias("observation_offset"))
    df = cal.resolve_observation_session(grid, F.col("observation_offset"))
    return df.select("lockup_id", "observation_offset", "observation_session")


@register("d9_session_walk", """
 SELECT o_orderkey, count(*) AS steps, min(s.session) AS first, max(s.session) AS last FROM (
  SELECT o_orderkey, next_ix AS a, next_ix + CAST(o_custkey % 41 AS INT) - 20 AS b FROM orders JOIN cal ON day = CAST(o_orderdate AS DATE))
 JOIN ses s ON s.ix BETWEEN least(a, b) AND greatest(a, b) GROUP BY 1""")
def walk(w):
    df = w.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    df = cal.with_session_index(df, "day", "").withColumn(
        "b", F.col("next_ix") + (F.col("o_custkey") % 41).cast("int") - 20)
    steps = cal.session_walk(df.select("o_orderkey", "next_ix", "b"), "next_ix", "b")
    return cal.with_session_at(steps, F.col("ix"), "session").groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("steps"), F.min("session").alias("first"), F.max("session").alias("last"))


@register("e1_event_dates", "SELECT lockup_id, event_date, event_date_source FROM lock")
def event_dates(w):
    return ev.with_event_date(w.lockups()).select("lockup_id", "event_date", "event_date_source")


def events_of(w):
    from lockstep.operators.snapshots import event_rows
    return event_rows(w.lockups(), w.ipos(), ev.primary_security(w.securities()))


@register("e2_as_of_forward", """
 SELECT lockup_id, ev.event_date, event_trade_date, event_bn FROM ev LEFT JOIN aligned USING (security_id, event_date)""")
def as_of(w):
    events = events_of(w).select("lockup_id", "security_id", "event_date")
    aligned = ev.align_to_bars(events, w.bars())
    return events.join(aligned, ["security_id", "event_date"], "left").select(
        "lockup_id", "event_date", "event_trade_date", "event_bn")


@register("e3_stored_bar_offset", """
 SELECT lockup_id, k AS bar_offset, n.trade_date AS bar_date, round(n.close, 6) AS bar_close FROM ev JOIN aligned USING (security_id, event_date),
 (SELECT unnest([-60,-20,-5,1,20]) AS k) JOIN numbered n ON n.security_id = ev.security_id AND n.bn = event_bn + k""")
def bar_offset(w):
    events, bars = events_of(w).select("lockup_id", "security_id", "event_date"), w.bars()
    aligned = ev.align_to_bars(events, bars).where("event_bn is not null")
    hits = ev.stored_bar_offset(aligned, bars, (-60, -20, -5, 1, 20)).select(
        "security_id", "event_date", "bar_offset", "bar_date", F.round("bar_close", 6).alias("bar_close"))
    return events.join(hits, ["security_id", "event_date"]).select(
        "lockup_id", "bar_offset", "bar_date", "bar_close")


@register("e4_history_as_of", """
 SELECT p.security_id, count(*) AS bars, max(trade_date) AS last_bar, round(max(high), 6) AS high
 FROM prices p JOIN (SELECT security_id, DATE '1995-06-01' + CAST(security_id % 1500 AS INT) AS cutoff FROM sec) c
 ON c.security_id = p.security_id AND p.trade_date <= cutoff GROUP BY 1""")
def history(w):
    cutoffs = w.securities().select("security_id", F.date_add(
        F.lit("1995-06-01").cast("date"), (F.col("security_id") % 1500).cast("int")).alias("cutoff_date"))
    return ev.history_as_of(w.bars(), cutoffs).groupBy("security_id").agg(
        F.count(F.lit(1)).alias("bars"), F.max("trade_date").alias("last_bar"),
        F.round(F.max("high"), 6).alias("high"))


@register("e5_primary_security", "SELECT company_id, security_id FROM prim")
def primary(w):
    return ev.primary_security(w.securities())


@register("d8_horizon_guard", """
 SELECT o_orderkey, shifted IS NULL OR shifted BETWEEN (SELECT min(day) FROM cal) AND (SELECT max(day) FROM cal) AS accepted,
  CASE WHEN shifted NOT BETWEEN (SELECT min(day) FROM cal) AND (SELECT max(day) FROM cal) THEN 'date ' || shifted::VARCHAR END AS reason_start FROM (
 SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + ((o_orderkey % 7 - 3) * 6000)::INT END AS shifted FROM orders)""")
def horizon_guard(w):
    """Order dates moved by years to either side, a fifth of them missing: what passes, and why the rest does not."""
    days = order_days(w).select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.date_add(
        "day", ((F.col("o_orderkey") % 7 - 3) * 6000).cast("int"))).alias("shifted"))
    good, rejected = split_by_horizon(days, "shifted")
    told = F.regexp_extract("reason", r"^(date \S+)", 1)
    return good.select("o_orderkey", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason_start")).union(
        rejected.select("o_orderkey", F.lit(False), told))
