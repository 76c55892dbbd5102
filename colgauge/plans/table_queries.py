"""Registered queries over sources, cleaning, profiles, checks, evidence, texts and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colgauge.functions import scalars
from colgauge.operators import clean, evidence, guards, profile, sampling, text
from colgauge.operators.linkage import attach_feature, merge_rankings
from colgauge.plans.rank_queries import BASE, FEATURE_SQL, NEW, feature_rows
from colgauge.plans.registry import BASE_SQL, MODEL_SQL, Tables, day_text, history, model_rows, query, rnd
from colgauge.session import scratch_path
from colgauge.sources import attempts, sinks, tables

FEATURES = clean.FeatureSet("y", tuple(BASE), tuple(NEW), ("id",))


# ---- sources and sinks ----
@query("read_csv_table", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def read_csv_table(t: Tables) -> DataFrame:
    """A table written as csv and read back under a declared schema."""
    path = scratch_path(t.spark, "customer") + ".csv"
    t.customer.drop("c_mktsegment").write.csv(path, header=True)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double"
    return tables.read_table(t.spark, path, schema=schema).withColumn("c_acctbal", rnd("c_acctbal", 2))


@query("read_headerless", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier")
def read_headerless(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "supplier")
    marked = t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") == 3, "?").otherwise(F.col("s_nationkey").cast("string")))
    marked.write.csv(path, header=False)
    return tables.read_headerless(t.spark, path, ["s_suppkey", "s_nationkey"], schema="a bigint, b int")


SPLIT_SQL = f"WITH {MODEL_SQL} SELECT split, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS positives FROM model GROUP BY 1"


@query("load_splits", SPLIT_SQL)
def load_splits(t: Tables) -> DataFrame:
    """Three split folders written, then read and united under one contract."""
    rows = model_rows(t)
    paths = {}
    for name in tables.SPLITS:
        paths[name] = scratch_path(t.spark, name)
        rows.filter(F.col("split") == name).drop("split").write.parquet(paths[name])
    united = tables.load_splits(t.spark, paths, "y")
    return united.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("positives"))


@query("from_frames", SPLIT_SQL)
def from_frames(t: Tables) -> DataFrame:
    rows = model_rows(t)
    united = tables.from_frames({s: rows.filter(F.col("split") == s).drop("split") for s in tables.SPLITS}, "y")
    return united.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("positives"))


@query("write_splits", SPLIT_SQL)
def write_splits(t: Tables) -> DataFrame:
    path = sinks.write_splits(feature_rows(t), FEATURES, scratch_path(t.spark, "splits"))
    return t.spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("positives"))


@query("write_linked", f"""{BASE_SQL} SELECT m.id, count(*) AS n FROM model m
JOIN hist h ON m.key = h.key AND h.event_time < m.as_of GROUP BY 1""")
def write_linked(t: Tables) -> DataFrame:
    from colgauge.operators.linkage import link_point_in_time

    linked = link_point_in_time(model_rows(t), history(t), key="key", time="event_time")
    path = sinks.write_linked(linked.select("id", "as_of", "event_id"), scratch_path(t.spark, "linked"))
    return t.spark.read.parquet(path).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("row_counts", " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS n_rows FROM {n}" for n in ("orders", "lineitem", "events")))
def row_counts(t: Tables) -> DataFrame:
    counted = tables.row_counts(t.spark, {n: t.path(n) for n in ("orders", "lineitem", "events")})
    return counted.filter("n_bytes > 0").select("source", "n_rows")


@query("extract_cut", f"WITH {MODEL_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem "
       "WHERE l_orderkey IN (SELECT id FROM model WHERE split = 'test')")
def extract_cut(t: Tables) -> DataFrame:
    """A source cut to the ids of the screen, kept on disk and read back while it is still valid."""
    ids = model_rows(t).filter("split = 'test'").select(F.col("id").alias("l_orderkey"))
    path = scratch_path(t.spark, "extract")
    source = tables.scan_source(t.spark, t.path("lineitem"))
    sinks.save_extract(t.spark, source, t.path("lineitem"), ids, "l_orderkey", path)
    kept = sinks.load_extract(t.spark, t.path("lineitem"), ids, "l_orderkey", path)
    if kept is None:
        kept = sinks.extract_cut(source, ids, "l_orderkey")
    return kept.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


def _run_log(t: Tables) -> str:
    """The events table as a run log: users are runs, and each kind of event an entry."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    entry = F.when(kind.isin("purchase", "error", "click"), "feature_screened").when(kind == "view", "tool_completed").otherwise("ideas_sent_back")
    reason = F.when(kind == "error", F.when(F.col("value") > 50, "script failed: bad column").otherwise(
        "redundant: |rho|=0.95 against the existing column 'price', above the limit")).when(
        kind == "click", F.when(F.col("value") > 50, "Gini gain +0.0001 is not above +0.0050").otherwise("no signal: the feature alone"))
    rows = t.events.select(
        entry.alias("event"), user.alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"),
        F.col("event_id").cast("string").alias("intent"), F.concat(F.lit("f"), F.col("event_id")).alias("name"),
        F.lit("L1").alias("level"), (kind == "purchase").alias("verified"), reason.alias("reason"),
        (F.col("value") / 10000).alias("delta"), (F.col("value") / 400).alias("coverage"),
        F.when(kind == "view", F.to_json(F.struct(F.lit(False).alias("ok"), F.when(
            F.col("value") > 50, "no confirmed linkage for the source").otherwise("that name is already taken").alias("error")))).alias("output"),
        F.when(kind == "signup", "no ideas fit").alias("error"),
    )
    path = scratch_path(t.spark, "run-log")
    rows.write.json(path)
    return path


ATTEMPT_SQL = """att AS (SELECT CAST(user_id AS VARCHAR) AS run_id, ts, event_id, value, event_type,
  CASE WHEN event_type IN ('purchase', 'error', 'click') THEN 'feature' ELSE 'sent_back' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'error' THEN CASE WHEN value > 50 THEN 'script_error' ELSE 'redundant' END
    WHEN 'click' THEN CASE WHEN value > 50 THEN 'below_gate' ELSE 'no_signal' END
    WHEN 'view' THEN CASE WHEN value > 50 THEN 'no_linkage' ELSE 'name' END ELSE 'ideas' END AS outcome FROM events)"""


@query("read_attempt_log", f"WITH {ATTEMPT_SQL} SELECT run_id, kind, outcome, count(*) AS n FROM att GROUP BY ALL")
def read_attempt_log(t: Tables) -> DataFrame:
    return attempts.read_attempt_log(t.spark, _run_log(t)).groupBy("run_id", "kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("outcome_rollup", f"""WITH {ATTEMPT_SQL} SELECT kind, outcome, count(*) AS n, CAST(outcome = 'verified' AS INTEGER) AS success,
  min_by(CASE WHEN kind = 'feature' THEN 'f' || event_id END, ts) AS example FROM att GROUP BY kind, outcome""")
def outcome_rollup(t: Tables) -> DataFrame:
    found = evidence.outcome_rollup(attempts.read_attempt_log(t.spark, _run_log(t)))
    return found.select("kind", "outcome", "n", "success", "example")


@query("append_history", f"""WITH {MODEL_SQL} SELECT id AS feature, 'accepted' AS outcome, '' AS failed_at FROM model WHERE y = 1
UNION ALL SELECT id, 'rejected', 'gini gain' FROM model WHERE y = 0 AND priority < 4 UNION ALL
SELECT id, 'rejected', 'screen' FROM model WHERE y = 0 AND priority >= 4""")
def append_history(t: Tables) -> DataFrame:
    """Orders as proposals, judged by their status; appended to a history and read back."""
    rows = model_rows(t)
    proposals = rows.select(F.col("id").alias("feature"), F.col("price").alias("delta"), F.lit(None).cast("string").alias("error"))
    judged = rows.filter("y = 1 OR priority < 4").select(
        F.col("id").alias("feature"), F.when(F.col("y") == 1, "PASS").otherwise("FAIL").alias("verdict"),
        F.lit("gini gain").alias("failed_at"), F.lit("too small").alias("reason"))
    path = sinks.append_history(proposals, judged, scratch_path(t.spark, "history"))
    return t.spark.read.parquet(path).select("feature", "outcome", "failed_at")


# ---- names, ids, missing values ----
@query("sanitize_columns", "SELECT o_orderkey AS order_key, o_totalprice AS total_pct, o_custkey AS who_and_when FROM orders")
def sanitize_columns(t: Tables) -> DataFrame:
    raw = t.orders.select(F.col("o_orderkey").alias("Order  Key"), F.col("o_totalprice").alias("Total (%)"), F.col("o_custkey").alias("Who & When?"))
    return clean.sanitize_columns(raw)[0]


DIRTY_SQL = """dirty AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN -9999 WHEN user_id % 11 = 0 THEN CAST('NaN' AS DOUBLE)
  WHEN user_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS v, CASE WHEN event_type = 'view' THEN -9999 ELSE user_id END AS u FROM events)"""


def _dirty(t: Tables) -> DataFrame:
    u = F.col("user_id")
    return t.events.select(
        "event_id",
        F.when(u % 7 == 0, -9999.0).when(u % 11 == 0, F.lit(float("nan"))).when(u % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("v"),
        F.when(F.col("event_type") == "view", -9999).otherwise(u).alias("u"),
    )


@query("clean_missing", f"WITH {DIRTY_SQL} SELECT event_id, CASE WHEN v = -9999 OR isnan(v) OR isinf(v) THEN NULL ELSE v END AS v, "
       "nullif(u, -9999) AS u FROM dirty")
def clean_missing(t: Tables) -> DataFrame:
    return clean.clean_missing(_dirty(t), ["v", "u"])


@query("count_converted", f"""WITH {DIRTY_SQL} SELECT 'v' AS feature, count(*) FILTER (v = -9999 OR isnan(v) OR isinf(v)) AS n_converted FROM dirty
UNION ALL SELECT 'u', count(*) FILTER (u = -9999) FROM dirty""")
def count_converted(t: Tables) -> DataFrame:
    return clean.count_converted(_dirty(t), ["v", "u"])


@query("sentinel_counts", f"""WITH {MODEL_SQL} SELECT 'y' AS feature, 0 AS n_coded, 1 AS only_0_1 UNION ALL
SELECT 'priority', count(*) FILTER (priority IN (5, 9)), 0 FROM model""")
def sentinel_counts(t: Tables) -> DataFrame:
    return clean.sentinel_counts(model_rows(t), ["y", "priority"], [5, 9]).withColumn("n_coded", F.col("n_coded").cast("bigint"))


@query("missing_indicators", f"{FEATURE_SQL} SELECT id, CAST(qty IS NULL AS INTEGER) AS qty_is_missing, "
       "CAST(disc IS NULL AS INTEGER) AS disc_is_missing, CAST(returned IS NULL AS INTEGER) AS returned_is_missing FROM feat")
def missing_indicators(t: Tables) -> DataFrame:
    out, _, made = clean.add_missing_indicators(feature_rows(t), FEATURES)
    return out.select("id", *made)


@query("build_id", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderstatus AS id FROM orders")
def build_id(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("o_custkey", F.col("o_custkey").cast("double"))
    return scalars.build_id(rows, "{o_custkey}_{o_orderdate:%Y%m%d}_{o_orderstatus}").select("o_orderkey", "id")


@query("id_problems", """WITH c AS (SELECT o_custkey, o_orderdate, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, 0 AS blank_ids, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_ids FROM c""")
def id_problems(t: Tables) -> DataFrame:
    return scalars.id_problems(scalars.build_id(t.orders, "{o_custkey}_{o_orderdate:%Y%m%d}_{o_orderstatus}"))


@query("parse_id", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS key, strftime(o_orderdate, '%Y-%m-%d') AS as_of, o_orderstatus AS marker FROM orders")
def parse_id(t: Tables) -> DataFrame:
    made = scalars.build_id(t.orders, "{o_custkey}_{o_orderdate:%Y%m%d}_{o_orderstatus}")
    return scalars.parse_id(made, "id").select("o_orderkey", "key", day_text("as_of").alias("as_of"), "marker")


@query("normalise_month", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders")
def normalise_month(t: Tables) -> DataFrame:
    written = F.when(F.col("o_custkey") % 5 == 0, "unknown").when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(
        F.date_format("o_orderdate", "MMMyy"))
    return t.orders.select("o_orderkey", scalars.normalise_month(written).alias("month"))


@query("key_text", "SELECT l_orderkey || '|' || l_linenumber || '|' || l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1")
def key_text(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(scalars.key_text(["l_orderkey", "l_linenumber", "l_returnflag"]).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("safe_ratio", "SELECT event_id, round(CASE WHEN value - 10 > 0 THEN user_id / (value - 10) END, 6) AS ratio FROM events")
def safe_ratio(t: Tables) -> DataFrame:
    return t.events.select("event_id", rnd(scalars.safe_ratio("user_id", F.col("value") - 10)).alias("ratio"))


@query("scalar_functions", """SELECT event_id, round(ln(value + 1), 6) AS logged, round(sqrt(value), 6) AS root,
  least(greatest(value, 5), 100) AS clipped, CAST(floor(value / 10) AS BIGINT) AS tens, upper(event_type) AS kind,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, strftime(last_day(CAST(ts AS DATE)), '%Y-%m-%d') AS month_end,
  CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS days_ago FROM events""")
def scalar_functions(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select(
        "event_id", rnd(F.ln(v + 1)).alias("logged"), rnd(F.sqrt(v)).alias("root"),
        F.least(F.greatest(v, F.lit(5.0)), F.lit(100.0)).alias("clipped"), F.floor(v / 10).alias("tens"), F.upper("event_type").alias("kind"),
        F.from_json("props", "k bigint")["k"].alias("k"), day_text(F.last_day("ts")).alias("month_end"),
        scalars.days_between(F.lit("2024-02-01").cast("timestamp"), F.col("ts")).alias("days_ago"),
    )


@query("rows_for_ids", """WITH w AS (SELECT l_orderkey AS id, min(l_suppkey * 10 + l_linenumber) AS place FROM lineitem GROUP BY 1)
SELECT w.id, place, c_custkey FROM w JOIN customer ON w.id = c_custkey""")
def rows_for_ids(t: Tables) -> DataFrame:
    listed = t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("place"))
    return clean.rows_for_ids(t.customer.withColumn("id", F.col("c_custkey")), listed).select("id", "place", "c_custkey")


@query("missing_ids", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT c_custkey FROM customer)")
def missing_ids(t: Tables) -> DataFrame:
    return clean.missing_ids(t.customer.select(F.col("c_custkey").alias("id")), t.lineitem.select(F.col("l_orderkey").alias("id")))


@query("drop_held_out", f"WITH {MODEL_SQL} SELECT id, y FROM model WHERE id NOT IN (SELECT id FROM model WHERE split = 'valid')")
def drop_held_out(t: Tables) -> DataFrame:
    rows = model_rows(t)
    return clean.drop_held_out(rows, rows.filter("split = 'valid'")).select("id", "y")


# ---- profiles ----
PROFILED = ["o_orderstatus", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("profile", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n_rows, 0.0::DOUBLE AS missing_rate, count(DISTINCT {c}) AS n_unique FROM orders" for c in PROFILED))
def profile_orders(t: Tables) -> DataFrame:
    return profile.profile_columns(t.orders, PROFILED).select("feature", "n_rows", rnd("missing_rate").alias("missing_rate"), "n_unique")


@query("column_examples", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high, "
    f"(SELECT string_agg(v, ';') FROM (SELECT DISTINCT {c} AS v FROM orders ORDER BY 1 LIMIT 3)) AS examples FROM orders"
    for c in ("o_orderstatus", "o_orderpriority")))
def column_examples(t: Tables) -> DataFrame:
    out = profile.column_examples(t.orders, ["o_orderstatus", "o_orderpriority"], 3)
    return out.withColumn("examples", F.array_join("examples", ";"))


@query("low_variation", "SELECT 'steady' AS feature, round(stddev_samp(1000 + l_linenumber) / avg(1000 + l_linenumber), 6) AS variation FROM lineitem")
def low_variation(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("steady", F.col("l_linenumber") + 1000)
    return profile.low_variation(rows, ["steady", "l_quantity", "l_extendedprice"]).withColumn("variation", rnd("variation"))


@query("class_mix", f"WITH {MODEL_SQL} SELECT split, count(*) AS n_rows, count(*) FILTER (y = 1) AS positives, round(avg(y), 6) AS rate FROM model GROUP BY 1")
def class_mix(t: Tables) -> DataFrame:
    return profile.class_mix(model_rows(t), "y", "split").withColumn("rate", rnd("rate"))


@query("coverage", "SELECT count(*) AS n_ids, round(avg(CAST(o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS INTEGER)), 6) AS coverage FROM orders")
def coverage(t: Tables) -> DataFrame:
    feature = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("v"))
    return profile.coverage(feature, model_rows(t), "v").withColumn("coverage", rnd("coverage"))


@query("attach_feature", """SELECT l.l_orderkey, l.l_linenumber, c.n FROM lineitem l
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c ON l.l_orderkey = c.l_orderkey""")
def attach(t: Tables) -> DataFrame:
    feature = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return attach_feature(t.lineitem.select("l_orderkey", "l_linenumber"), guards.require_grain(feature, "l_orderkey"), "l_orderkey")


# ---- guards ----
@query("check_finite", f"WITH {DIRTY_SQL} SELECT 'v' AS feature, count(*) AS n_bad FROM dirty WHERE isinf(v)")
def check_finite(t: Tables) -> DataFrame:
    return guards.check_finite(_dirty(t), "v", "event_id").select("feature", "n_bad")


@query("check_scale", f"""{FEATURE_SQL}, s AS (SELECT split, CASE WHEN id % 5000 = 7 AND price > 0 THEN price * 1e6 ELSE price END AS m FROM feat)
SELECT split, round(max(m), 2) AS largest, round(quantile_cont(m, 0.99), 2) AS bulk,
  CAST(max(m) > 1000 * quantile_cont(m, 0.99) AS INTEGER) AS spike FROM s GROUP BY 1""")
def check_scale(t: Tables) -> DataFrame:
    spiked = feature_rows(t).withColumn("price", F.when(F.col("id") % 5000 == 7, F.col("price") * 1e6).otherwise(F.col("price")))
    return guards.check_scale(spiked, "price").select("split", rnd("largest", 2).alias("largest"), rnd("bulk", 2).alias("bulk"), "spike")


@query("check_redundancy", f"""{FEATURE_SQL}, r AS (SELECT rank() OVER (ORDER BY twice) + (count(*) OVER (PARTITION BY twice) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS b FROM (SELECT price, price + nation * 5000 AS twice FROM feat))
SELECT 'twice' AS feature, 'price' AS nearest, round(corr(a, b), 6) AS max_abs_rho, CAST(corr(a, b) > 0.7 AS INTEGER) AS redundant FROM r""")
def check_redundancy(t: Tables) -> DataFrame:
    rows = feature_rows(t).withColumn("twice", F.col("price") + F.col("nation") * 5000)
    return guards.check_redundancy(rows, "id", "twice", BASE, 0.7).withColumn("max_abs_rho", rnd("max_abs_rho"))


@query("check_grain", "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, "
       "count(*) AS n_ids, count(*) FILTER (n > 1) AS repeated_ids, 0 AS missing_ids FROM c")
def check_grain(t: Tables) -> DataFrame:
    return guards.check_grain(t.lineitem, "l_orderkey")


@query("preflight", """SELECT * FROM (VALUES ('training split', 'PASS'), ('resolved feature set', 'PASS'), ('numeric model inputs', 'PASS'),
('complete target', 'PASS'), ('binary target', 'PASS'), ('analysis splits available', 'PASS'), ('id columns present', 'PASS'),
('split ids are disjoint', 'PASS'), ('candidate source', 'PASS'), ('comparison baseline requested', 'PASS'),
('per-candidate verdict evidence', 'PASS'), ('batch verdict evidence', 'PASS')) v("check", status)""")
def preflight(t: Tables) -> DataFrame:
    return guards.preflight(feature_rows(t), FEATURES).select("check", "status")


@query("check_prepared", f"""{BASE_SQL}, s AS (SELECT key FROM model GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT 'split ids are disjoint' AS "check", CASE WHEN (SELECT count(*) FROM s) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
UNION ALL SELECT * FROM (VALUES ('splits', 'PASS'), ('target present', 'PASS'), ('binary target', 'PASS'), ('declared columns exist', 'PASS'),
('candidates declared', 'PASS'), ('id columns present', 'PASS')) v""")
def check_prepared(t: Tables) -> DataFrame:
    """Customers recur across the out-of-time splits, which the check has to say."""
    by_customer = clean.FeatureSet("y", tuple(BASE), tuple(NEW), ("key",))
    return guards.check_prepared(feature_rows(t), by_customer).select("check", "status")


@query("check_disjoint_screen", f"WITH {MODEL_SQL} SELECT (SELECT count(DISTINCT key) FROM model WHERE split = 'train' AND key IN (SELECT key FROM model WHERE split = 'valid')) AS fit_and_scored, "
       "(SELECT count(DISTINCT key) FROM model WHERE split <> 'test' AND key IN (SELECT key FROM model WHERE split = 'test')) AS test_rows_used")
def check_disjoint_screen(t: Tables) -> DataFrame:
    rows = model_rows(t)
    part = lambda s: rows.filter(F.col("split") == s)
    return guards.check_disjoint_screen(part("train"), part("valid"), part("test"), "key")


# ---- evidence ----
EVIDENCE_SQL = """ev AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'signal' WHEN 'click' THEN 'none' WHEN 'error' THEN
  CASE WHEN value > 50 THEN NULL ELSE 'none' END END AS e FROM events)"""


@query("evidence_standing", f"""WITH {EVIDENCE_SQL}, c AS (SELECT user_id, count(*) FILTER (e = 'signal') AS signal, count(*) FILTER (e = 'none') AS "none" FROM ev GROUP BY 1)
SELECT user_id, signal, "none", CASE WHEN signal > 0 THEN 'active' WHEN "none" > 0 THEN 'low' ELSE 'explore' END AS status,
  CAST(1 + signal AS DOUBLE) AS alpha, CAST(1 + 0.5 * "none" AS DOUBLE) AS beta, round((1 + signal) / (2 + signal + 0.5 * "none"), 6) AS p_useful FROM c""")
def evidence_standing(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    reason = F.when(kind == "error", F.when(F.col("value") > 50, "script failed: bad column").otherwise("redundant")).when(kind == "click", "no signal")
    rows = t.events.withColumn("evidence", evidence.feature_evidence(kind == "purchase", reason))
    return evidence.evidence_standing(rows, "user_id").withColumn("p_useful", rnd("p_useful"))


@query("pool_families", """WITH f AS (SELECT o_orderkey AS key, o_orderstatus AS s, first_value(o_orderkey) OVER (
    PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS family FROM orders),
c AS (SELECT family, count(*) FILTER (s = 'F') AS signal, count(*) FILTER (s = 'O') AS "none", count(*) AS members FROM f GROUP BY 1)
SELECT f.key, f.family, c.signal, c."none", c.members, CASE WHEN signal > 0 THEN 'active' WHEN "none" > 0 THEN 'low' ELSE 'explore' END AS status,
  round((1 + signal) / (2 + signal + 0.5 * "none"), 6) AS p_useful FROM f JOIN c ON f.family = c.family""")
def pool_families(t: Tables) -> DataFrame:
    """Orders as records, each linked to the customer's order of that priority before it."""
    from pyspark.sql import Window

    along = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    records = t.orders.select(
        F.col("o_orderkey").alias("key"), F.lag("o_orderkey").over(along).alias("same_as"),
        (F.col("o_orderstatus") == "F").cast("int").alias("signal"), (F.col("o_orderstatus") == "O").cast("int").alias("none"))
    out = evidence.pool_families(records)
    return out.select("key", "family", "signal", "none", "members", "status", rnd("p_useful").alias("p_useful"))


@query("repeated_reasons", """SELECT 'redundant' AS pattern, 'price' AS subject, count(*) AS n FROM events WHERE event_type = 'error' AND value <= 50
UNION ALL SELECT 'below base', '', count(*) FROM events WHERE event_type = 'click' AND value > 50
UNION ALL SELECT 'sparse', '', count(*) FROM events WHERE value / 400 < 0.05""")
def repeated_reasons(t: Tables) -> DataFrame:
    log = attempts.read_events(t.spark, _run_log(t))
    return evidence.repeated_reasons(log.select("reason", "coverage"))


# ---- texts ----
def words_sql(value: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    return (f"list_transform(list_filter(regexp_extract_all(lower({value}), '[a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN ({stop})), "
            "lambda w: CASE WHEN len(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)")


@query("text_similarity", f"""WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1, (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)),
tok AS (SELECT id, unnest({words_sql('text')}) AS w FROM d), tf AS (SELECT id, w, count(*) AS tf FROM tok GROUP BY 1, 2),
idf AS (SELECT w, ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
x AS (SELECT id, tf.w, tf * idf AS v FROM tf JOIN idf ON tf.w = idf.w), n AS (SELECT id, sqrt(sum(v * v)) AS n FROM x GROUP BY 1),
dot AS (SELECT a.id, sum(a.v * b.v) AS d FROM x a JOIN x b ON a.w = b.w AND b.id = -1 AND a.id <> -1 GROUP BY 1)
SELECT d.id AS doc_id, round(coalesce(dot.d / (n.n * (SELECT n FROM n WHERE id = -1)), 0), 6) + 0.0 AS similarity
FROM d LEFT JOIN dot ON d.id = dot.id LEFT JOIN n ON d.id = n.id WHERE d.id <> -1""")
def text_similarity(t: Tables) -> DataFrame:
    asked = t.benchmark.orderBy("item_id").first().text
    return text.text_similarity(t.documents, "doc_id", "text", asked).withColumn("similarity", rnd("similarity"))


@query("text_nearest", f"""WITH d AS (SELECT 0 AS k, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
tok AS (SELECT k, id, unnest({words_sql('text')}) AS w FROM d), tf AS (SELECT k, id, w, count(*) AS tf FROM tok GROUP BY ALL),
idf AS (SELECT w, ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
x AS (SELECT k, id, tf.w, tf * idf AS v FROM tf JOIN idf ON tf.w = idf.w), n AS (SELECT k, id, sqrt(sum(v * v)) AS n FROM x GROUP BY ALL),
dot AS (SELECT a.id, b.id AS item_id, sum(a.v * b.v) AS d FROM x a JOIN x b ON a.w = b.w AND a.k = 0 AND b.k = 1 GROUP BY ALL),
s AS (SELECT dot.id, item_id, round(d / (a.n * b.n), 6) AS similarity FROM dot JOIN n a ON a.k = 0 AND a.id = dot.id JOIN n b ON b.k = 1 AND b.id = item_id),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, item_id) = 1)
SELECT doc_id, item_id, coalesce(similarity, 0) + 0.0 AS similarity FROM documents LEFT JOIN best ON doc_id = id""")
def text_nearest(t: Tables) -> DataFrame:
    """Every document with the nearest of all benchmark passages."""
    out = text.nearest_passages(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")
    return out.withColumn("similarity", rnd("similarity"))


@query("novelty", f"""WITH it AS (SELECT conv_id * 1000 + turn AS id, conv_id AS run, turn AS round, {words_sql('text')} AS ws FROM conversations),
tf AS (SELECT id, run, round, w, count(*) AS tf FROM (SELECT id, run, round, unnest(ws) AS w FROM it) GROUP BY ALL),
idf AS (SELECT w, ln((1.0::DOUBLE + (SELECT count(*) FROM it)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
x AS (SELECT id, run, round, tf.w, tf * idf AS v FROM tf JOIN idf ON tf.w = idf.w),
n AS (SELECT id, sqrt(sum(v * v)) AS n FROM x GROUP BY 1),
p AS (SELECT b.id, a.id AS other, sum(a.v * b.v) AS d FROM x a JOIN x b ON a.w = b.w AND (a.run, a.round) < (b.run, b.round) GROUP BY 1, 2),
s AS (SELECT p.id, max(p.d / (na.n * nb.n)) AS overlap, arg_min(p.other, (-round(p.d / (na.n * nb.n), 9), o.run, o.round, p.other)) AS repeated
      FROM p JOIN n na ON p.other = na.id JOIN n nb ON p.id = nb.id JOIN it o ON o.id = p.other
      WHERE p.d / (na.n * nb.n) >= 0.6 GROUP BY 1)
SELECT it.id, it.run, it.round, round(s.overlap, 6) AS overlap, s.repeated FROM it LEFT JOIN s ON it.id = s.id""")
def novelty(t: Tables) -> DataFrame:
    """Each turn of a conversation as an idea: does it repeat an earlier one?"""
    items = t.conversations.withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    out = text.novelty(items, "id", "conv_id", "turn", "text")
    return out.select("id", "run", "round", rnd("overlap").alias("overlap"), "repeated")


@query("novelty_per_round", """WITH f AS (SELECT user_id AS run, event_type, CAST(strftime(ts, '%j') AS INTEGER) AS round FROM events),
g AS (SELECT run, round, count(*) AS proposed, count(*) FILTER (event_type <> 'view') AS new FROM f GROUP BY 1, 2)
SELECT run, round, proposed, new, proposed - new AS repeated, CAST(sum(new) OVER (ORDER BY run, round) AS BIGINT) AS cumulative_new FROM g""")
def novelty_per_round(t: Tables) -> DataFrame:
    items = t.events.select(F.col("user_id").alias("run"), F.dayofyear("ts").alias("round"), (F.col("event_type") == "view").alias("repeats"))
    return evidence.novelty_per_round(items)


@query("normalised_duplicates", r"""WITH d AS (SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]+', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS h FROM documents)
SELECT h AS fingerprint, min(doc_id) AS first_id, count(*) AS copies FROM d GROUP BY 1 HAVING count(*) > 1""")
def normalised_duplicates(t: Tables) -> DataFrame:
    return text.normalised_duplicates(t.documents, "doc_id", "text")


# ---- samples ----
@query("stratified_split", f"""WITH {MODEL_SQL}, c AS (SELECT y, count(*) AS n FROM model GROUP BY 1), s AS (SELECT unnest(['train', 'valid', 'test']) AS part)
SELECT y, part, CAST(CASE part WHEN 'train' THEN n - 2 * round(n * 0.2) ELSE round(n * 0.2) END AS BIGINT) AS n FROM c, s""")
def stratified_split(t: Tables) -> DataFrame:
    split = sampling.stratified_split(model_rows(t), "y", ["id"], name="part")
    return split.groupBy("y", "part").agg(F.count(F.lit(1)).alias("n"))


@query("balanced_sample", f"WITH {MODEL_SQL} SELECT y, least(count(*), 2000) AS n FROM model GROUP BY 1")
def balanced_sample(t: Tables) -> DataFrame:
    sample = sampling.balanced_sample(model_rows(t), "y", ["id"], 4000)
    return sample.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("uniform_sample", f"WITH {MODEL_SQL} SELECT least(count(*), 3000) AS n, least(count(*), 3000) AS n_ids FROM model")
def uniform_sample(t: Tables) -> DataFrame:
    sample = sampling.uniform_sample(model_rows(t), ["id"], 3000)
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("split_by_time", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-06-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1999-06-01' THEN 'valid' ELSE 'test' END AS split FROM orders")
def split_by_time(t: Tables) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return sampling.split_by_time(t.orders, "o_orderdate", day("1997-06-01"), day("1999-06-01")).select("o_orderkey", "split")


@query("top_k_per_group", """SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""")
def top_k_per_group(t: Tables) -> DataFrame:
    return sampling.top_k_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("rotate_batches", "SELECT c_custkey, CAST(floor(c_custkey / 100) AS BIGINT) AS batch FROM customer WHERE floor(c_custkey / 100) = 17 % (floor((SELECT max(c_custkey) FROM customer) / 100) + 1)")
def rotate_batches(t: Tables) -> DataFrame:
    return sampling.rotate_batches(t.customer, "c_custkey", 100, 17).select("c_custkey", "batch")


# ---- rankings, reports, set operations ----
@query("merge_rankings", """WITH a AS (SELECT l_returnflag AS variant, CAST(l_linenumber AS VARCHAR) AS feature, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2),
i AS (SELECT l_linestatus AS variant, CAST(l_linenumber AS VARCHAR) AS feature, max(l_tax) AS g FROM lineitem GROUP BY 1, 2)
SELECT coalesce(a.variant, i.variant) AS variant, coalesce(a.feature, i.feature) AS feature, round(a.m, 6) AS mean_abs_attr, i.g AS importance
FROM a FULL JOIN i ON a.variant = i.variant AND a.feature = i.feature""")
def merge(t: Tables) -> DataFrame:
    feature = F.col("l_linenumber").cast("string").alias("feature")
    a = t.lineitem.groupBy(F.col("l_returnflag").alias("variant"), feature).agg(rnd(F.avg("l_quantity")).alias("mean_abs_attr"))
    i = t.lineitem.groupBy(F.col("l_linestatus").alias("variant"), feature).agg(F.max("l_tax").alias("importance"))
    return merge_rankings(a, i)


@query("worst_report", """WITH v AS (SELECT l_partkey, round(stddev_samp(l_quantity), 6) AS spread FROM lineitem GROUP BY 1)
SELECT l_partkey, spread FROM v ORDER BY spread DESC NULLS LAST, l_partkey LIMIT 10""")
def worst_report(t: Tables) -> DataFrame:
    """A top-n report: the ten parts of the widest quantities."""
    spread = t.lineitem.groupBy("l_partkey").agg(rnd(F.stddev_samp("l_quantity")).alias("spread"))
    return spread.orderBy(F.desc_nulls_last("spread"), "l_partkey").limit(10)


@query("pinned_report", """WITH v AS (SELECT l_partkey, round(stddev_samp(l_quantity), 6) AS spread, max(l_quantity) AS largest FROM lineitem GROUP BY 1),
h AS (SELECT * FROM v ORDER BY spread DESC NULLS LAST, l_partkey LIMIT 10)
SELECT * FROM h UNION ALL SELECT * FROM v WHERE largest < 40 AND l_partkey NOT IN (SELECT l_partkey FROM h)""")
def pinned_report(t: Tables) -> DataFrame:
    """The ten parts of the widest quantities, and below them each part that never sells by the forty."""
    spread = t.lineitem.groupBy("l_partkey").agg(rnd(F.stddev_samp("l_quantity")).alias("spread"), F.max("l_quantity").alias("largest"))
    return sampling.head_report(spread, "l_partkey", [F.desc_nulls_last("spread"), F.asc("l_partkey")], 10, F.col("largest") < 40)


@query("peek", """WITH k AS (SELECT min(c) AS low, max(c) AS high FROM (SELECT count(*) AS c FROM lineitem))
SELECT least(50000, low) AS n, TRUE AS own FROM k""")
def peek(t: Tables) -> DataFrame:
    """How many rows a look at the line items holds, and whether all of them are theirs."""
    looked = tables.peek(t.lineitem, 50_000)
    known = t.lineitem.select("l_orderkey", "l_linenumber").distinct().withColumn("_known", F.lit(True))
    return looked.join(known, ["l_orderkey", "l_linenumber"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.every(F.coalesce("_known", F.lit(False))), F.lit(True)).alias("own"))


@query("resolve_features", """SELECT 'base' AS kind, count(o_totalprice) AS held, 'o_totalprice' AS feature FROM orders
UNION ALL SELECT 'base', count(o_custkey), 'o_custkey' FROM orders""")
def resolve_features(t: Tables) -> DataFrame:
    """The numeric columns of the orders that are left as features, and how many values each has."""
    orders = t.orders
    found = clean.resolve_features(orders, "o_orderstatus", id_cols=["o_orderkey"], exclude=["o_shippriority"])
    kinds = {**dict.fromkeys(found.base, "base"), **dict.fromkeys(found.new, "new")}
    counted = orders.agg(*[F.count(c).alias(c) for c in kinds]).unpivot([], list(kinds), "feature", "held")
    named = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return counted.select(named[F.col("feature")].alias("kind"), "held", "feature")


@query("inherited_evidence", """WITH c AS (SELECT conv_id * 1000 + turn AS key, CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) THEN conv_id * 1000 + turn - 1 END AS same_as,
    CAST(role = 'user' AS INT) AS signal, CAST(role <> 'user' AS INT) AS "none", length(text) % 3 AS i, length(text) AS n FROM conversations),
r AS (SELECT * FROM c WHERE n > 60),
k AS (SELECT r.*, r.same_as IS NOT NULL AND p.key IS NULL AS gone, p.key IS NOT NULL AS linked FROM r LEFT JOIN (SELECT key FROM r) p ON p.key = r.same_as),
f AS (SELECT *, max(CASE WHEN NOT linked THEN key END) OVER (PARTITION BY key // 1000 ORDER BY key) AS family FROM k),
t AS (SELECT family, CAST(sum(signal + CASE WHEN gone THEN i ELSE 0 END) AS BIGINT) AS signal, CAST(sum("none" + CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS "none", count(*) AS members FROM f GROUP BY 1)
SELECT f.key, f.family, t.signal, t."none", t.members FROM f JOIN t USING (family)""")
def inherited_evidence(t: Tables) -> DataFrame:
    """Turns linked to the turn before; short ones are gone, and what was inherited from them takes their place."""
    from pyspark.sql import Window

    key = F.col("conv_id") * 1000 + F.col("turn")
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    records = t.conversations.select(
        key.alias("key"), F.when(F.col("turn") > first, key - 1).alias("same_as"), (F.col("role") == "user").cast("int").alias("signal"),
        (F.col("role") != "user").cast("int").alias("none"), (F.length("text") % 3).alias("was_signal"), F.lit(1).alias("was_none"), F.length("text").alias("n"))
    out = evidence.pool_families(records.filter("n > 60"), inherited_signal="was_signal", inherited_none="was_none")
    return out.select("key", "family", "signal", "none", "members")


@query("union_runs", "SELECT o_orderkey AS id, 'orders' AS run FROM orders UNION ALL SELECT DISTINCT l_orderkey, 'items' FROM lineitem")
def union_runs(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct().withColumn("run", F.lit("items"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("run")).unionByName(items)


@query("first_per_id", "SELECT l_orderkey AS id, min(l_extendedprice) AS first_price FROM lineitem GROUP BY 1")
def first_per_id(t: Tables) -> DataFrame:
    """One row per id, the first made explicit by an order."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.struct("l_extendedprice", "l_linenumber")).alias("_f")).select(
        "id", F.col("_f.l_extendedprice").alias("first_price"))


@query("shared_ids", "SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def shared_ids(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("id")).intersect(t.events.select(F.col("user_id").alias("id")))


@query("unknown_ids", "SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def unknown_ids(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("id")).subtract(t.events.select(F.col("user_id").alias("id")))


@query("project_named", "SELECT o_orderkey AS id, o_orderdate < TIMESTAMP '1998-01-01' AS early, o_totalprice AS price FROM orders")
def project_named(t: Tables) -> DataFrame:
    """Only the id, the as-of date and the one column a feature names reach the scan."""
    early = F.col("as_of") < F.lit("1998-01-01").cast("timestamp_ntz")
    return clean.project_named(model_rows(t), ["price"]).select("id", early.alias("early"), "price")


@query("cut_window", f"{BASE_SQL} SELECT m.id, count(*) AS n FROM model m JOIN hist h ON m.key = h.key AND h.event_time < m.as_of "
       "AND h.event_time >= m.as_of - INTERVAL 200 DAY GROUP BY 1")
def cut_window(t: Tables) -> DataFrame:
    """A window taken from rows linked without one."""
    from colgauge.operators.linkage import cut_window as cut, link_point_in_time

    linked = link_point_in_time(model_rows(t), history(t), key="key", time="event_time")
    return cut(linked, "event_time", "as_of", 200).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("write_artifacts", f"WITH {MODEL_SQL} SELECT split, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS positives FROM model GROUP BY 1")
def write_artifacts(t: Tables) -> DataFrame:
    """A small table written as csv beside row-scale scores as parquet, and both read back."""
    rows = model_rows(t)
    small = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    written = sinks.write_artifacts({"mix": small, "predictions": rows.select("split", "id", "y")}, scratch_path(t.spark, "artifacts"))
    scores = t.spark.read.parquet(written["predictions"]).groupBy("split").agg(F.sum("y").alias("positives"))
    mix = tables.read_table(t.spark, written["mix"], format="csv", schema="split string, n_rows bigint")
    return mix.join(scores, "split").select("split", "n_rows", "positives")
