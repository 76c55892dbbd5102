"""Registered queries over point-in-time joins and event summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colgauge.operators import aggregate as agg, linkage as link
from colgauge.plans.registry import BASE_SQL, Tables, day_text, history, model_rows, query, rnd, time_text


def _linked(t: Tables, days: int | None = None, rule: str = "strict") -> DataFrame:
    return link.link_point_in_time(model_rows(t), history(t), key="key", time="event_time", days=days, rule=rule)


@query("agg_per_id_90d", f"""{BASE_SQL}, f AS (
  SELECT m.id, count(*) AS n_90d, sum(h.amount) AS amount_90d, max(h.amount) AS max_90d
  FROM model m JOIN hist h ON m.key = h.key AND h.event_time < m.as_of
       AND h.event_time >= m.as_of - INTERVAL 90 DAY GROUP BY m.id)
SELECT m.id, m.y, m.split, f.n_90d, round(f.amount_90d, 4) AS amount_90d, f.max_90d
FROM model m LEFT JOIN f ON m.id = f.id""")
def agg_per_id_90d(t: Tables) -> DataFrame:
    """J1 -> A1 -> J7: each order's customer history of the 90 days before it."""
    feature = agg.aggregate_per_id(
        _linked(t, days=90),
        [F.count(F.lit(1)).alias("n_90d"), F.sum("amount").alias("amount_90d"), F.max("amount").alias("max_90d")],
        time="event_time", days=90,
    )
    rows = link.attach_feature(model_rows(t), feature)
    return rows.select("id", "y", "split", "n_90d", rnd("amount_90d", 4).alias("amount_90d"), "max_90d")


@query("pit_link", f"""{BASE_SQL}
SELECT m.id, h.event_id, h.amount, strftime(h.event_time, '%Y-%m-%d') AS event_day
FROM model m JOIN hist h ON m.key = h.key AND h.event_time < m.as_of""")
def pit_link(t: Tables) -> DataFrame:
    return _linked(t).select("id", "event_id", "amount", day_text("event_time").alias("event_day"))


@query("pit_link_inclusive", f"""{BASE_SQL}
SELECT m.id, h.event_id, h.amount FROM model m JOIN hist h ON m.key = h.key AND h.event_time <= m.as_of
  AND h.event_time >= m.as_of - INTERVAL 365 DAY""")
def pit_link_inclusive(t: Tables) -> DataFrame:
    return _linked(t, days=365, rule="inclusive").select("id", "event_id", "amount")


@query("linkage_check", f"""{BASE_SQL}, linked AS (
  SELECT m.id, m.as_of, h.event_time FROM model m JOIN hist h ON m.key = h.key AND h.event_time < m.as_of)
SELECT count(*) AS n_rows, (SELECT count(*) FROM model) AS n_ids, count(DISTINCT id) AS matched_ids,
  CAST(count(*) FILTER (event_time >= as_of) AS BIGINT) AS late_rows,
  CAST(count(*) FILTER (event_time IS NULL) AS BIGINT) AS unparsed_rows,
  CAST(count(*) FILTER (id NOT IN (SELECT id FROM model)) AS BIGINT) AS unknown_ids,
  round(count(DISTINCT id) / (SELECT count(*) FROM model), 6) AS match_rate FROM linked""")
def linkage_check(t: Tables) -> DataFrame:
    checked = link.check_linkage(_linked(t), model_rows(t), time="event_time")
    return checked.withColumn("match_rate", rnd("match_rate"))


@query("linkage_scale", f"""{BASE_SQL}, per AS (
  SELECT m.id, count(*) AS n FROM model m JOIN hist h ON m.key = h.key AND h.event_time < m.as_of
  WHERE m.split = 'train' GROUP BY m.id)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS matched_ids, max(n) AS max_per_id,
  round(sum(n) / count(*), 6) AS events_per_id,
  CAST(round(sum(n) * (SELECT count(*) FROM model) / (SELECT count(*) FROM model WHERE split = 'train')) AS BIGINT)
    AS projected_rows FROM per""")
def linkage_scale(t: Tables) -> DataFrame:
    rows = model_rows(t)
    train = rows.filter("split = 'train'")
    linked = link.link_point_in_time(train, history(t), key="key", time="event_time")
    sized = link.linkage_scale(
        linked, train.agg(F.count(F.lit(1))).scalar(), rows.agg(F.count(F.lit(1))).scalar()
    )
    return sized.withColumn("events_per_id", rnd("events_per_id"))


@query("size_join", """WITH l AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(sum(a.n * b.n), 0) AS m, max(a.n) AS ml, max(b.n) AS mr, max(a.n * b.n) AS big
      FROM l a JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k)
SELECT CAST(m + (SELECT count(*) FROM lineitem) AS BIGINT) AS n_rows,
  CAST(ml > 1 AND mr > 1 AS INTEGER) AS many_to_many, mr AS left_per_key, ml AS right_per_key,
  big AS largest_key, (SELECT count(*) FROM lineitem) AS left_rows,
  (SELECT count(*) FROM lineitem) AS right_rows FROM j""")
def size_join(t: Tables) -> DataFrame:
    left = t.lineitem.select(F.col("l_partkey").alias("k"))
    right = t.lineitem.select(F.col("l_suppkey").alias("k"))
    return link.size_join(left, right, "k", how="left")


@query("guard_join", """SELECT o.o_orderkey, c.c_nationkey, c.c_acctbal
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def guard_join(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    right = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return link.guard_join(left, right, "c_custkey").select("o_orderkey", "c_nationkey", "c_acctbal")


@query("last_event_before", f"""{BASE_SQL}, ranked AS (
  SELECT m.id, h.event_time, h.event_id, h.amount,
    row_number() OVER (PARTITION BY m.id ORDER BY h.event_time DESC, h.event_id DESC) AS rn
  FROM model m JOIN hist h ON m.key = h.key AND h.event_time < m.as_of)
SELECT m.id, r.event_id, r.amount, strftime(r.event_time, '%Y-%m-%d') AS event_day
FROM model m LEFT JOIN ranked r ON m.id = r.id AND r.rn = 1""")
def last_event_before(t: Tables) -> DataFrame:
    found = link.last_event_before(
        model_rows(t), history(t), key="key", time="event_time", tie="event_id", payload=["amount"]
    )
    return found.select("id", "event_id", "amount", day_text("event_time").alias("event_day"))


@query("nth_last_event", f"""{BASE_SQL}, ranked AS (
  SELECT m.id, h.event_id, h.amount,
    row_number() OVER (PARTITION BY m.id ORDER BY h.event_time DESC, h.event_id DESC) AS rn
  FROM model m JOIN hist h ON m.key = h.key AND h.event_time < m.as_of)
SELECT id, event_id, amount FROM ranked WHERE rn = 2""")
def nth_last_event(t: Tables) -> DataFrame:
    found = link.nth_event_before(model_rows(t), history(t), 2, key="key", time="event_time", tie="event_id", payload=["amount"])
    return found.select("id", "event_id", "amount")


@query("rolling_windows", f"""{BASE_SQL}
SELECT m.id,
  count(h.event_id) FILTER (h.event_time >= m.as_of - INTERVAL 30 DAY) AS n_events_30d,
  round(coalesce(sum(h.amount) FILTER (h.event_time >= m.as_of - INTERVAL 30 DAY), 0), 3) + 0.0 AS amount_sum_30d,
  count(h.event_id) FILTER (h.event_time >= m.as_of - INTERVAL 90 DAY) AS n_events_90d,
  round(coalesce(sum(h.amount) FILTER (h.event_time >= m.as_of - INTERVAL 90 DAY), 0), 3) + 0.0 AS amount_sum_90d,
  count(h.event_id) FILTER (h.event_time >= m.as_of - INTERVAL 180 DAY) AS n_events_180d,
  round(coalesce(sum(h.amount) FILTER (h.event_time >= m.as_of - INTERVAL 180 DAY), 0), 3) + 0.0 AS amount_sum_180d
FROM model m LEFT JOIN hist h ON m.key = h.key AND h.event_time < m.as_of GROUP BY m.id""")
def rolling_windows(t: Tables) -> DataFrame:
    out = link.window_totals(
        model_rows(t), history(t), key="key", time="event_time", measure="amount", windows=[30, 90, 180]
    )
    return out.select("id", *[c for w in (30, 90, 180) for c in (
        F.col(f"n_events_{w}d").cast("bigint").alias(f"n_events_{w}d"),
        rnd(f"amount_sum_{w}d", 3).alias(f"amount_sum_{w}d"))])


@query("rolling_rows", """SELECT event_id, count(*) OVER w AS n_7d, round(sum(value) OVER w, 4) AS value_7d FROM events
WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def rolling_rows(t: Tables) -> DataFrame:
    """Per-event running totals within each user's day."""
    from pyspark.sql import Window

    e = t.events
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("n_7d"), rnd(F.sum("value").over(w), 4).alias("value_7d"))


@query("rolling_events_7d", """SELECT event_id, count(*) OVER w AS n_7d, round(sum(value) OVER w, 4) + 0.0 AS value_7d FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""")
def rolling_events_7d(t: Tables) -> DataFrame:
    """For each event its user's last seven days, to the microsecond."""
    out = link.rolling_totals(t.events, key="user_id", time="ts", measure="value", days=7, id_col="event_id", n="n_7d", total="value_7d")
    return out.select("event_id", "n_7d", rnd("value_7d", 4).alias("value_7d"))


def _period_sql(end: str) -> str:
    return f"""SELECT user_id, strftime({end}, '%Y-%m-%d') AS period_end, count(*) AS n_events,
  round(sum(value), 4) AS value_sum, count(*) FILTER (event_type = 'purchase') AS n_purchases,
  round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) + 0.0 AS purchase_sum,
  round(sum(value * value), 5) AS value_sq, count(DISTINCT event_type) AS n_types,
  strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
FROM events GROUP BY 1, 2"""


def _by_period(t: Tables, period: str) -> DataFrame:
    value, bought = F.col("value"), F.col("event_type") == "purchase"
    out = agg.aggregate_by_period(t.events, "user_id", "ts", period, [
        F.count(F.lit(1)).alias("n_events"),
        F.sum(value).alias("value_sum"),
        F.count_if(bought).alias("n_purchases"),
        F.coalesce(F.sum(F.when(bought, value)), F.lit(0.0)).alias("purchase_sum"),
        F.sum(value * value).alias("value_sq"),
        F.count_distinct("event_type").alias("n_types"),
        F.min("ts").alias("first_day"),
        F.max("ts").alias("last_day"),
    ])
    return out.select(
        "user_id", day_text("period_end").alias("period_end"), "n_events", rnd("value_sum", 4).alias("value_sum"),
        "n_purchases", rnd("purchase_sum", 4).alias("purchase_sum"), rnd("value_sq", 5).alias("value_sq"), "n_types",
        day_text("first_day").alias("first_day"), day_text("last_day").alias("last_day"),
    )


DAY_END = "CAST(ts AS DATE)"
WEEK_END = "CAST(date_trunc('week', ts) AS DATE) + 6"
MONTH_END = "last_day(CAST(ts AS DATE))"
query("agg_by_day", _period_sql(DAY_END))(lambda t: _by_period(t, "day"))
query("agg_by_week", _period_sql(WEEK_END))(lambda t: _by_period(t, "week"))
query("agg_by_month", _period_sql(MONTH_END))(lambda t: _by_period(t, "month"))


@query("conditional_aggs", """SELECT user_id, count(DISTINCT event_type) AS n_types,
  max(value) AS max_value, round(avg(CAST(event_type = 'purchase' AS INTEGER)), 6) AS purchase_share,
  round(sum(value) FILTER (event_type = 'click') / nullif(sum(value), 0), 6) AS click_value_share,
  date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS active_days
FROM events GROUP BY user_id""")
def conditional_aggs(t: Tables) -> DataFrame:
    from colgauge.functions.scalars import safe_ratio

    out = t.events.groupBy("user_id").agg(
        F.count_distinct("event_type").alias("n_types"),
        F.max("value").alias("max_value"),
        F.avg((F.col("event_type") == "purchase").cast("int")).alias("purchase_share"),
        F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("_click"),
        F.sum("value").alias("_all"),
        F.datediff(F.max("ts"), F.min("ts")).cast("bigint").alias("active_days"),
    )
    return out.select("user_id", "n_types", "max_value", rnd("purchase_share").alias("purchase_share"),
                      rnd(safe_ratio("_click", "_all")).alias("click_value_share"), "active_days")


MONTHLY_SQL = """monthly AS (SELECT o_custkey AS key, last_day(CAST(o_orderdate AS DATE)) AS period_end,
  sum(o_totalprice) AS amount, count(*) AS n FROM orders GROUP BY 1, 2)"""


def _monthly(t: Tables) -> DataFrame:
    """Months of each key; events that no as-of date can see do not leave the scan."""
    return agg.aggregate_by_period(
        link.bounded_source(history(t), model_rows(t), "event_time"), "key", "event_time", "month", [F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")]
    )


@query("link_monthly", f"""{BASE_SQL}, {MONTHLY_SQL}
SELECT m.id, count(*) AS n_months, CAST(sum(a.n) AS BIGINT) AS n_orders, round(sum(a.amount), 3) AS amount,
  strftime(max(a.period_end), '%Y-%m-%d') AS last_month
FROM model m JOIN monthly a ON m.key = a.key AND a.period_end < m.as_of GROUP BY m.id""")
def link_monthly(t: Tables) -> DataFrame:
    linked = link.link_aggregate(model_rows(t), _monthly(t), key="key", slice_rows=link.SLICE)
    return linked.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_months"), F.sum("n").alias("n_orders"),
        rnd(F.sum("amount"), 3).alias("amount"), day_text(F.max("period_end")).alias("last_month"),
    )


@query("recent_vs_before", f"""{BASE_SQL}, {MONTHLY_SQL}, aged AS (
  SELECT m.id, a.amount, date_diff('month', a.period_end, CAST(m.as_of AS DATE)) AS age
  FROM model m JOIN monthly a ON m.key = a.key AND a.period_end < m.as_of),
s AS (SELECT id, avg(amount) FILTER (age BETWEEN 1 AND 3) AS r, avg(amount) FILTER (age BETWEEN 4 AND 12) AS b
      FROM aged GROUP BY id)
SELECT id, round(r, 6) AS recent_mean, round(b, 6) AS before_mean,
  round(CASE WHEN b > 0 THEN r / b END, 6) AS recent_ratio FROM s""")
def recent_vs_before(t: Tables) -> DataFrame:
    linked = link.link_aggregate(model_rows(t), _monthly(t), key="key", slice_rows=link.SLICE)
    months = lambda c: F.year(c) * 12 + F.month(c)
    out = agg.recent_vs_before(linked, "amount", months("as_of") - months("period_end"), 3, 9)
    return out.select("id", rnd("recent_mean", 6).alias("recent_mean"), rnd("before_mean", 6).alias("before_mean"),
                      rnd("recent_ratio").alias("recent_ratio"))


@query("join_periods", f"""{BASE_SQL}, a AS (SELECT user_id AS id, CAST(ts AS DATE) AS p, count(*) AS n
  FROM events WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT user_id AS id, CAST(ts AS DATE) AS p, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
j AS (SELECT a.id, a.p, a.n, b.v, row_number() OVER (PARTITION BY a.id ORDER BY a.p DESC) AS rn
  FROM a JOIN b ON a.id = b.id AND a.p = b.p)
SELECT id, strftime(p, '%Y-%m-%d') AS period_end, n, round(v, 4) AS v FROM j WHERE rn = 1""")
def join_periods(t: Tables) -> DataFrame:
    e = t.events.withColumnRenamed("user_id", "id")
    a = agg.aggregate_by_period(e.filter("event_type = 'click'"), "id", "ts", "day", [F.count(F.lit(1)).alias("n")])
    b = agg.aggregate_by_period(e.filter("event_type = 'purchase'"), "id", "ts", "day", [F.sum("value").alias("v")])
    out = link.join_periods(a, b)
    return out.select("id", day_text("period_end").alias("period_end"), "n", rnd("v", 4).alias("v"))


@query("trend_slope", """SELECT user_id AS id,
  round(regr_slope(value, epoch(date_trunc('second', ts)) / 86400.0), 6) + 0.0 AS slope FROM events GROUP BY 1""")
def trend_slope(t: Tables) -> DataFrame:
    days = F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(86400.0)
    out = agg.trend_slope(t.events.withColumnRenamed("user_id", "id"), "id", days, "value")
    return out.select("id", rnd("slope").alias("slope"))


@query("grain_violations", """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n,
  min(l_returnflag) <> max(l_returnflag) AS f, min(l_linestatus) <> max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2)
SELECT count(*) AS n_grains, count(*) FILTER (n > 1) AS repeated_grains,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_rows,
  count(*) FILTER (f) AS split_by_l_returnflag, count(*) FILTER (s) AS split_by_l_linestatus FROM g""")
def grain_violations(t: Tables) -> DataFrame:
    return agg.grain_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("moved_periods", """WITH a AS (SELECT l_orderkey, last_day(CAST(l_shipdate AS DATE)) AS p FROM lineitem GROUP BY 1, 2),
b AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS p FROM orders)
SELECT l_orderkey, strftime(p, '%Y-%m-%d') AS period_end FROM a WHERE p NOT IN (SELECT p FROM b)""")
def moved_periods(t: Tables) -> DataFrame:
    monthly = agg.aggregate_by_period(t.lineitem, "l_orderkey", "l_shipdate", "month", [F.count(F.lit(1)).alias("n")])
    out = agg.moved_periods(monthly, t.orders, "o_orderdate", "month")
    return out.select("l_orderkey", day_text("period_end").alias("period_end"))


@query("backfill_columns", """SELECT e.event_id, c.c_nationkey, c.c_acctbal FROM events e
JOIN customer c ON e.user_id = c.c_custkey""")
def backfill_columns(t: Tables) -> DataFrame:
    sample = t.events.select("event_id", F.col("user_id").alias("c_custkey"))
    return link.backfill_columns(sample, t.customer, "c_custkey", ["c_nationkey", "c_acctbal"]).drop("c_custkey")


@query("disjoint_splits", f"""{BASE_SQL}, s AS (SELECT DISTINCT key, split FROM model)
SELECT a.split AS left_split, b.split AS right_split, count(*) AS shared_ids, min(CAST(a.key AS VARCHAR)) AS example
FROM s a JOIN s b ON a.key = b.key AND a.split < b.split GROUP BY 1, 2""")
def disjoint_splits(t: Tables) -> DataFrame:
    return link.disjoint_splits(model_rows(t), "key")
