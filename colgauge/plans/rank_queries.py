"""Registered queries over ranks, bins and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colgauge.operators import binning, cases, metrics, order, ranks
from colgauge.session import materialise
from colgauge.plans.registry import BASE_SQL, MODEL_SQL, Tables, model_rows, query, rnd

# ---- feature rows: line items summed to orders, with gaps where a sum is empty ----
FEATURE_SQL = f"""WITH {MODEL_SQL}, li AS (
  SELECT l_orderkey, sum(l_quantity) AS qty, avg(l_discount) AS disc,
    sum(l_extendedprice) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
feat AS (SELECT m.*, CAST(l.qty AS DOUBLE) AS qty, round(l.disc, 6) AS disc, round(l.returned, 2) AS returned, c.c_acctbal AS acctbal,
    CAST(c.c_nationkey AS DOUBLE) AS nation
  FROM model m LEFT JOIN li l ON m.id = l.l_orderkey LEFT JOIN customer c ON m.key = c.c_custkey)"""
BASE = ["price", "acctbal", "nation"]
NEW = ["qty", "disc", "returned"]


def feature_rows(t: Tables) -> DataFrame:
    """Model rows with three incumbents and three candidates, two of them with gaps."""
    items = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        rnd(F.avg("l_discount")).alias("disc"),
        rnd(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), 2).alias("returned"),
    )
    who = t.customer.select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation")
    )
    return (
        model_rows(t).join(items, F.col("id") == F.col("l_orderkey"), "left").drop("l_orderkey").join(who, "key", "left")
    )


def rank_sql(column: str, source: str = "feat", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    peers = f"{by}, {column}" if by else column
    return (f"CASE WHEN {column} IS NOT NULL THEN rank() OVER ({part}ORDER BY {column}) "
            f"+ (count(*) OVER (PARTITION BY {peers}) - 1) / 2.0 END")


@query("average_rank", f"""{FEATURE_SQL}, r AS (
  SELECT id, 'price' AS feature, price AS v FROM feat WHERE price IS NOT NULL
  UNION ALL SELECT id, 'nation', nation FROM feat WHERE nation IS NOT NULL
  UNION ALL SELECT id, 'returned', returned FROM feat WHERE returned IS NOT NULL)
SELECT id, feature, CAST(rank() OVER (PARTITION BY feature ORDER BY v)
  + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS DOUBLE) AS avg_rank FROM r""")
def average_rank(t: Tables) -> DataFrame:
    return ranks.average_rank(feature_rows(t), "id", ["price", "nation", "returned"]).select("id", "feature", "avg_rank")


RANKED_SQL = f"""{FEATURE_SQL}, tr AS (SELECT * FROM feat WHERE split = 'train'), rk AS (
  SELECT id, y, {', '.join(f'{rank_sql(c)} AS {c}' for c in [*BASE, *NEW])}, {rank_sql('y')} AS ry FROM tr)"""


def _pair_rows(pairs: list[tuple[str, str]], other: str | None = None) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature, '{b}' AS other, round(corr({a}, {b}), 6) + 0.0 AS rho, "
        f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM rk" for a, b in pairs
    )


PAIRS = [(a, b) for a in NEW for b in [*BASE, *NEW] if a != b]


@query("spearman_pairs", f"{RANKED_SQL} {_pair_rows(PAIRS)}".replace("SELECT id, y,", "SELECT id, y,"))
def spearman_pairs(t: Tables) -> DataFrame:
    train = feature_rows(t).filter("split = 'train'")
    out = ranks.spearman_pairs(train, "id", PAIRS, method="aggregates")
    return out.withColumn("rho", rnd("rho"))


@query("spearman_blocks", f"{RANKED_SQL} {_pair_rows(PAIRS)}")
def spearman_blocks(t: Tables) -> DataFrame:
    """The same pairs as sums of matrix products, the form for many columns."""
    train = feature_rows(t).filter("split = 'train'")
    out = ranks.spearman_pairs(train, "id", PAIRS, method="blocks")
    return out.withColumn("rho", rnd("rho"))


@query("spearman_target", f"{RANKED_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, ry), 6) + 0.0 AS rho FROM rk" for c in NEW))
def spearman_target(t: Tables) -> DataFrame:
    train = feature_rows(t).filter("split = 'train'")
    return ranks.spearman_target(train, "id", NEW, "y").select("feature", rnd("rho").alias("rho"))


@query("same_values", f"""{FEATURE_SQL}, b AS (SELECT qty, returned FROM feat WHERE qty IS NOT NULL AND returned IS NOT NULL),
r AS (SELECT {rank_sql('qty')} AS a, {rank_sql('returned')} AS b FROM b)
SELECT 'qty' AS feature, 'returned' AS other, count(*) AS n, round(corr(a, b), 6) + 0.0 AS rho,
  CAST(abs(corr(a, b)) >= 0.99 AS INTEGER) AS same FROM r""")
def same_values(t: Tables) -> DataFrame:
    out = ranks.same_values(feature_rows(t), "id", "qty", "returned")
    return out.withColumn("rho", rnd("rho"))


CENTRED_SQL = f"""{RANKED_SQL}, cen AS (SELECT id, {', '.join(
    f'coalesce({c} - avg({c}) OVER (), 0) AS {c}' for c in [*BASE, *NEW])} FROM rk)"""


@query("nearest_column", f"""{CENTRED_SQL}, p AS ({' UNION ALL '.join(
    f"SELECT '{a}' AS feature, '{b}' AS other, sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})) AS rho FROM cen"
    for a in NEW for b in BASE)}),
q AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(rho) DESC) AS rn FROM p)
SELECT feature, other AS nearest, round(rho, 6) AS nearest_rho, round(abs(rho), 6) AS max_abs_rho FROM q WHERE rn = 1""")
def nearest_column(t: Tables) -> DataFrame:
    train = feature_rows(t).filter("split = 'train'")
    out = ranks.nearest_column(train, "id", NEW, BASE)
    return out.select("feature", "nearest", rnd("nearest_rho").alias("nearest_rho"), rnd("max_abs_rho").alias("max_abs_rho"))


@query("residual_rho", f"""{FEATURE_SQL}, tr AS (SELECT id, qty, returned, y - price / 500000 AS res FROM feat WHERE split = 'valid'),
rk AS (SELECT {rank_sql('qty')} AS qty, {rank_sql('returned')} AS returned, {rank_sql('res')} AS res FROM tr),
cen AS (SELECT {', '.join(f'coalesce({c} - avg({c}) OVER (), 0) AS {c}' for c in ('qty', 'returned', 'res'))} FROM rk)
{' UNION ALL '.join(f"SELECT '{a}' AS feature, round(sum({a} * res) / sqrt(sum({a} * {a}) * sum(res * res)), 6) + 0.0 AS residual_rho FROM cen" for a in ('qty', 'returned'))}""")
def residual_rho(t: Tables) -> DataFrame:
    rows = feature_rows(t).filter("split = 'valid'").withColumn("pred", F.col("price") / 500000)
    return ranks.residual_rho(rows, "id", ["qty", "returned"], "y", "pred").withColumn("residual_rho", rnd("residual_rho"))


GINI_COLUMNS = ["price", "qty", "returned"]


@query("variable_gini", f"""{FEATURE_SQL}, l AS ({' UNION ALL '.join(
    f"SELECT split, '{c}' AS feature, y, coalesce({c}, quantile_cont({c}, 0.5) OVER (PARTITION BY split)) AS v FROM feat"
    for c in GINI_COLUMNS)}),
r AS (SELECT split, feature, y, rank() OVER (PARTITION BY split, feature ORDER BY v)
  + (count(*) OVER (PARTITION BY split, feature, v) - 1) / 2.0 AS r FROM l),
s AS (SELECT split, feature, sum(r) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y <> 1) AS n0
  FROM r GROUP BY 1, 2)
SELECT split, feature, round(abs(2 * (sr - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * n0) - 1), 6) AS variable_gini FROM s""")
def variable_gini(t: Tables) -> DataFrame:
    out = ranks.variable_gini(feature_rows(t), GINI_COLUMNS, "y", by=["split"])
    return out.withColumn("variable_gini", rnd("variable_gini"))


@query("quantiles", f"""{FEATURE_SQL} {' UNION ALL '.join(
    f"SELECT split, '{c}' AS feature, " + ', '.join(f"round(quantile_cont({c}, {p}), 4) AS p{int(p * 1000)}" for p in (0.005, 0.25, 0.5, 0.995))
    + " FROM feat GROUP BY 1" for c in GINI_COLUMNS)}""")
def exact_quantiles(t: Tables) -> DataFrame:
    probs = (0.005, 0.25, 0.5, 0.995)
    out = order.quantiles(feature_rows(t), GINI_COLUMNS, probs, by=["split"])
    return out.select("split", "feature", *[rnd(F.col("values")[i], 4).alias(f"p{int(p * 1000)}") for i, p in enumerate(probs)])


@query("no_signal_reason", """SELECT 'flat' AS feature, 'one value (1) on valid and test; it does vary on train, so its source may end too early' AS reason
UNION ALL SELECT 'gone', 'empty on test; it does vary on train, so its source may end too early'""")
def no_signal_reason(t: Tables) -> DataFrame:
    rows = model_rows(t).select(
        "split", "price",
        F.when(F.col("split") == "train", F.col("price")).otherwise(1.0).alias("flat"),
        F.when(F.col("split") != "test", F.col("price")).alias("gone"),
    )
    return ranks.no_signal_reason(rows, ["price", "flat", "gone"])


def edges_sql(columns: list[str], bins: int, source: str) -> str:
    probs = ", ".join(str(i / bins) for i in range(1, bins))
    return ", ".join(f"(SELECT list_sort(list_distinct(quantile_cont({c}, [{probs}]))) FROM {source}) AS e_{c}" for c in columns)


def code_sql(column: str, value: str | None = None) -> str:
    v = value or column
    return (f"CASE WHEN {v} IS NULL THEN len(e_{column}) + 1 "
            f"ELSE len(list_filter(e_{column}, lambda e: e <= {v})) END")


MI_COLUMNS = [*BASE, *NEW]
CODED_SQL = f"""{FEATURE_SQL}, tr AS (SELECT * FROM feat WHERE split = 'train'),
edges AS (SELECT {edges_sql(MI_COLUMNS, 20, 'tr')}),
coded AS (SELECT id, y, {', '.join(f'CAST({code_sql(c)} AS INTEGER) AS {c}' for c in MI_COLUMNS)} FROM tr, edges)"""


@query("quantile_codes", f"{CODED_SQL} SELECT id, {', '.join(MI_COLUMNS)} FROM coded")
def quantile_codes(t: Tables) -> DataFrame:
    train = feature_rows(t).filter("split = 'train'")
    edges = binning.quantile_edges(train, MI_COLUMNS, 20)
    return binning.quantile_codes(train, ["id"], edges)


def mi_sql(pairs: list[tuple[str, str]]) -> str:
    stacked = " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, {a} AS a, {b} AS b FROM coded" for a, b in pairs)
    return f"""st AS ({stacked}), j AS (SELECT feature, other, a, b, CAST(count(*) AS DOUBLE) AS n FROM st GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature, other) AS t, sum(n) OVER (PARTITION BY feature, other, a) AS na,
  sum(n) OVER (PARTITION BY feature, other, b) AS nb FROM j),
h AS (SELECT feature, other, greatest(sum(n / t * ln(n * t / (na * nb))), 0) AS mi,
  -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb FROM w GROUP BY 1, 2)"""


@query("mutual_info", f"""{CODED_SQL}, {mi_sql([(a, b) for a in NEW for b in [*BASE, *NEW] if a != b])}
SELECT feature, other, round(mi, 6) AS mi, round(CASE WHEN least(ha, hb) > 0 THEN mi / least(ha, hb) END, 6) AS nmi FROM h""")
def mutual_info(t: Tables) -> DataFrame:
    train = feature_rows(t).filter("split = 'train'")
    edges = binning.quantile_edges(train, MI_COLUMNS, 20)
    coded = binning.quantile_codes(train, [], edges)
    out = binning.mutual_info_pairs(coded, PAIRS)
    return out.select("feature", "other", rnd("mi").alias("mi"), rnd("nmi").alias("nmi"))


@query("target_mi", f"""{CODED_SQL}, {mi_sql([(c, 'y') for c in NEW])}
SELECT feature, round(mi, 6) AS mi_target, round(CASE WHEN least(ha, hb) > 0 THEN mi / least(ha, hb) END, 6) AS nmi_target FROM h""")
def target_mi(t: Tables) -> DataFrame:
    train = feature_rows(t).filter("split = 'train'")
    out = binning.target_mi(train, NEW, "y", 20)
    return out.select("feature", rnd("mi_target").alias("mi_target"), rnd("nmi_target").alias("nmi_target"))


def psi_sql(columns: list[str], by: str, reference: str, source: str, bins: int = 10) -> str:
    stacked = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {by} AS part, {code_sql(c)} AS code, len(e_{c}) + 2 AS levels FROM {source}, edges" for c in columns)
    return f"""edges AS (SELECT {edges_sql(columns, bins, f"(SELECT * FROM {source} WHERE {by} = '{reference}')")}),
st AS ({stacked}), cnt AS (SELECT feature, part, code, count(*) AS n FROM st GROUP BY ALL),
tot AS (SELECT feature, part, max(levels) AS levels, CAST(count(*) AS DOUBLE) AS t FROM st GROUP BY ALL),
grid AS (SELECT feature, part, t, unnest(range(levels)) AS code FROM tot),
sh AS (SELECT g.feature, g.part, g.code, greatest(coalesce(c.n, 0) / t, 0.5 / t) AS p
  FROM grid g LEFT JOIN cnt c ON g.feature = c.feature AND g.part = c.part AND g.code = c.code),
ps AS (SELECT o.feature, o.part, sum((r.p - o.p) * ln(r.p / o.p)) AS psi FROM sh o
  JOIN sh r ON o.feature = r.feature AND o.code = r.code AND r.part = '{reference}' WHERE o.part <> '{reference}' GROUP BY 1, 2)"""


@query("psi", f"""{FEATURE_SQL}, {psi_sql(MI_COLUMNS, 'split', 'train', 'feat')},
w AS (SELECT feature, max(psi) FILTER (part = 'valid') AS v, max(psi) FILTER (part = 'test') AS t FROM ps GROUP BY 1)
SELECT feature, round(v, 6) AS psi_valid, round(t, 6) AS psi_test, round(greatest(v, t), 6) AS psi_max,
  CASE WHEN v >= t THEN 'valid' ELSE 'test' END AS psi_worst_split FROM w""")
def psi(t: Tables) -> DataFrame:
    out = binning.distribution_check(feature_rows(t), MI_COLUMNS)
    return out.select("feature", *[rnd(c).alias(c) for c in ("psi_valid", "psi_test", "psi_max")], "psi_worst_split")


@query("psi_by_period", f"""{FEATURE_SQL}, dated AS (SELECT *, strftime(as_of, '%Y') AS yr FROM feat),
{psi_sql(['price', 'returned'], 'yr', '1995', 'dated')}
SELECT feature, part AS period, round(psi, 6) AS psi FROM ps""")
def psi_by_period(t: Tables) -> DataFrame:
    rows = feature_rows(t).withColumn("period", F.date_format("as_of", "yyyy"))
    return binning.stability_by_period(rows, ["price", "returned"], "period", "1995").withColumn("psi", rnd("psi"))


# ---- ranking metrics: three fixed score expressions stand for model variants ----
SCORES = {"base": "price / 500000", "loi__qty": "qty / 400", "loi__nation": "nation / 25"}
PRED_SQL = f"""{FEATURE_SQL}, pred AS ({' UNION ALL '.join(
    f"SELECT '{v}' AS variant, split, id, y, coalesce({s}, 0) AS score FROM feat" for v, s in SCORES.items())})"""


def predictions(t: Tables) -> DataFrame:
    """Long predictions, one row per variant and model row, kept as a written table."""
    f = feature_rows(t)
    scores = F.array(*[
        F.struct(F.lit(v).alias("variant"), F.coalesce(F.expr(s), F.lit(0.0)).alias("score")) for v, s in SCORES.items()
    ])
    long = f.select("split", "id", "y", F.explode(scores).alias("_s")).select("_s.variant", "split", "id", "y", "_s.score")
    return materialise(long, "predictions")


GINI_SQL = """blk AS (SELECT variant, split, score, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s FROM pred GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY variant, split ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM blk),
x1 AS (SELECT variant, split, (2 * sum(n * b + s * (n + 1) / 2) / sum(s) - 1) / sum(n) - 1 AS x FROM cum GROUP BY 1, 2),
yb AS (SELECT variant, split, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s FROM pred GROUP BY 1, 2),
x2 AS (SELECT variant, split, (2 * (s * (s + 1) / 2 + (n - s) * s) / s - 1) / n - 1 AS x FROM yb),
gini AS (SELECT x1.variant, x1.split, x1.x / x2.x AS adj_gini FROM x1 JOIN x2 ON x1.variant = x2.variant AND x1.split = x2.split)"""
TOP_SQL = """ord AS (SELECT *, row_number() OVER (PARTITION BY variant, split ORDER BY score DESC, id) AS rn,
  count(*) OVER (PARTITION BY variant, split) AS n, sum(y) OVER (PARTITION BY variant, split) AS sy FROM pred)"""
CAPTURE_SQL = TOP_SQL + """, cap AS (SELECT variant, split,
  sum(y) FILTER (rn <= floor(n * 0.01::DOUBLE)) / max(sy) AS c1, sum(y) FILTER (rn <= floor(n * 0.05::DOUBLE)) / max(sy) AS c5,
  sum(y) FILTER (rn <= floor(n * 0.1::DOUBLE)) / max(sy) AS c10 FROM ord GROUP BY 1, 2)"""
CALIB_SQL = """dec AS (SELECT variant, split, floor(10 * (rn - 1) / n) AS g, avg(score) AS p, avg(y) AS a FROM ord GROUP BY 1, 2, 3),
acc AS (SELECT variant, split, 1 - sum(abs(p - a)) / sum(abs(a)) AS accuracy FROM dec GROUP BY 1, 2)"""


@query("adjusted_gini", f"{PRED_SQL}, {GINI_SQL} SELECT variant, split, round(adj_gini, 6) + 0.0 AS adj_gini FROM gini")
def adjusted_gini(t: Tables) -> DataFrame:
    return metrics.adjusted_gini(predictions(t)).withColumn("adj_gini", rnd("adj_gini"))


@query("capture_rate", f"""{PRED_SQL}, {CAPTURE_SQL}
SELECT variant, split, round(c1, 6) AS top1, round(c5, 6) AS top5, round(c10, 6) AS top10 FROM cap""")
def capture_rate(t: Tables) -> DataFrame:
    out = metrics.capture_rate(predictions(t), [0.01, 0.05, 0.1])
    return out.select("variant", "split", rnd("`capture_rate_0.01`").alias("top1"),
                      rnd("`capture_rate_0.05`").alias("top5"), rnd("`capture_rate_0.1`").alias("top10"))


@query("calibration", f"{PRED_SQL}, {TOP_SQL}, {CALIB_SQL} SELECT variant, split, round(accuracy, 6) AS accuracy FROM acc")
def calibration(t: Tables) -> DataFrame:
    return metrics.calibration_accuracy(predictions(t)).withColumn("accuracy", rnd("accuracy"))


METRICS_SQL = f"""{PRED_SQL}, {GINI_SQL}, {CAPTURE_SQL}, {CALIB_SQL},
met AS (SELECT g.variant, g.split, g.adj_gini, a.accuracy, c.c1, c.c5, c.c10, m.n_rows, m.actual_mean, m.pred_mean
  FROM gini g JOIN acc a ON g.variant = a.variant AND g.split = a.split
  JOIN cap c ON g.variant = c.variant AND g.split = c.split
  JOIN (SELECT variant, split, count(*) AS n_rows, avg(y) AS actual_mean, avg(score) AS pred_mean FROM pred GROUP BY 1, 2) m
    ON g.variant = m.variant AND g.split = m.split)"""


@query("metrics_table", f"""{METRICS_SQL} SELECT variant, split, n_rows, round(adj_gini, 6) AS adj_gini,
  round(accuracy, 6) AS accuracy, round(actual_mean, 6) AS actual_mean, round(pred_mean, 6) AS pred_mean,
  round(c1, 6) AS top1, round(c5, 6) AS top5, round(c10, 6) AS top10 FROM met""")
def metrics_table(t: Tables) -> DataFrame:
    out = metrics.evaluate_predictions(predictions(t))
    return out.select(
        "variant", "split", "n_rows", *[rnd(c).alias(c) for c in ("adj_gini", "accuracy", "actual_mean", "pred_mean")],
        rnd("`capture_rate_0.01`").alias("top1"), rnd("`capture_rate_0.05`").alias("top5"), rnd("`capture_rate_0.1`").alias("top10"),
    )


def _comparison_sql() -> str:
    parts = []
    for s in ("train", "valid", "test"):
        parts += [
            f"round(max(m.adj_gini) FILTER (m.split = '{s}'), 6) AS adj_gini_{s}",
            f"round(max(m.c5) FILTER (m.split = '{s}'), 6) AS capture_top5_{s}",
            f"round(max(m.adj_gini - b.adj_gini) FILTER (m.split = '{s}'), 6) + 0.0 AS gini_gain_{s}",
            f"round(max((m.adj_gini - b.adj_gini) / abs(b.adj_gini)) FILTER (m.split = '{s}'), 5) + 0.0 AS gini_gain_pct_{s}",
            f"round(max(m.c5 - b.c5) FILTER (m.split = '{s}'), 6) + 0.0 AS capture_gain_top5_{s}",
        ]
    return f"""{METRICS_SQL} SELECT m.variant, {', '.join(parts)}
FROM met m JOIN met b ON m.split = b.split AND b.variant = 'base' GROUP BY 1"""


@query("comparison", _comparison_sql())
def comparison(t: Tables) -> DataFrame:
    out = metrics.wide_comparison(metrics.evaluate_predictions(predictions(t)))
    return out.select("variant", *[rnd(c, 5 if "gain_pct" in c else 6).alias(c) for c in out.columns if c != "variant"])


@query("score_cutoffs", f"""{PRED_SQL} SELECT variant, share, round(quantile_cont(score, 0.99), 6) AS cutoff FROM
  (SELECT *, 0.01::DOUBLE AS share FROM pred WHERE split = 'test') GROUP BY 1, 2""" + "".join(
    f""" UNION ALL SELECT variant, {s}::DOUBLE, round(quantile_cont(score, {1 - s}), 6) FROM pred WHERE split = 'test' GROUP BY 1"""
    for s in (0.02, 0.05, 0.1, 0.2)))
def score_cutoffs(t: Tables) -> DataFrame:
    return metrics.score_cutoffs(predictions(t)).withColumn("cutoff", rnd("cutoff"))


@query("score_level", f"""{PRED_SQL}, m AS (SELECT variant, avg(score) AS s FROM pred WHERE split = 'test' GROUP BY 1)
SELECT m.variant, round(m.s, 6) AS score_mean, round(b.s, 6) AS score_base, round(m.s / b.s - 1, 6) + 0.0 AS score_change
FROM m JOIN m b ON b.variant = 'base'""")
def score_level(t: Tables) -> DataFrame:
    out = metrics.score_level(predictions(t))
    return out.select("variant", *[rnd(c).alias(c) for c in ("score_mean", "score_base", "score_change")])


# ---- cases: a user's events are the rows of a case ----
SEQ_SQL = """seq AS (SELECT user_id, event_id, ts, value, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)"""


def _cases(t: Tables) -> DataFrame:
    return cases.sequence_cases(t.events, "user_id", "ts", "event_id", width=86_400)


@query("case_sequence", f"WITH {SEQ_SQL} SELECT event_id, user_id, t FROM seq")
def case_sequence(t: Tables) -> DataFrame:
    return _cases(t).select("event_id", "user_id", F.col("_t").alias("t"))


FLAGS_SQL = f"""WITH {SEQ_SQL}, f AS (SELECT user_id, count(*) AS n_rows,
  min(t) FILTER (value >= 120) AS first_base, min(t) FILTER (event_type = 'error' AND value >= 60) AS first_variant,
  min(ts) FILTER (value >= 120) AS time_base, min(ts) FILTER (event_type = 'error' AND value >= 60) AS time_variant
  FROM seq GROUP BY 1)"""


def _firsts(t: Tables) -> DataFrame:
    flags = {"base": F.col("value") >= 120, "variant": (F.col("event_type") == "error") & (F.col("value") >= 60)}
    return cases.first_flags(_cases(t), "user_id", "ts", flags)


@query("first_flag", f"{FLAGS_SQL} SELECT user_id, n_rows, first_base, first_variant FROM f")
def first_flag(t: Tables) -> DataFrame:
    return _firsts(t).select("user_id", "n_rows", "first_base", "first_variant")


OUTCOME_SQL = """CASE WHEN first_base IS NULL AND first_variant IS NULL THEN 'neither' WHEN first_base IS NULL THEN 'only_variant'
  WHEN first_variant IS NULL THEN 'only_base' WHEN first_variant < first_base THEN 'earlier'
  WHEN first_variant > first_base THEN 'later' ELSE 'same' END AS outcome"""


@query("flag_outcomes", f"""{FLAGS_SQL} SELECT user_id, {OUTCOME_SQL}, first_base - first_variant AS rows_sooner,
  CAST(floor((epoch_us(time_base) - epoch_us(time_variant)) / 86400000000.0) AS BIGINT) AS days_sooner FROM f""")
def flag_outcomes(t: Tables) -> DataFrame:
    return cases.flag_outcomes(_firsts(t)).select("user_id", "outcome", "rows_sooner", "days_sooner")


@query("outcome_counts", f"""{FLAGS_SQL}, o AS (SELECT {OUTCOME_SQL} FROM f) SELECT count(*) AS cases, {', '.join(
    f"count(*) FILTER (outcome = '{o}') AS {o}" for o in cases.OUTCOMES)} FROM o""")
def outcome_counts(t: Tables) -> DataFrame:
    return cases.outcome_counts(cases.flag_outcomes(_firsts(t)))


@query("event_gaps", """WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))
  / 86400000000.0 AS gap FROM events)
SELECT user_id, count(*) AS n_events, round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS max_gap FROM g GROUP BY 1""")
def event_gaps(t: Tables) -> DataFrame:
    out = cases.gap_summary(cases.event_gaps(t.events, "user_id", "ts", "event_id", width=86_400), "user_id")
    return out.select("user_id", "n_events", rnd("mean_gap").alias("mean_gap"), rnd("max_gap").alias("max_gap"))


@query("failed_streaks", f"""WITH {SEQ_SQL}, s AS (SELECT user_id, event_id, t FROM seq WHERE event_type = 'purchase')
SELECT event_id, user_id, t - 1 - coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t), 0) AS failed_before FROM s""")
def failed_streaks(t: Tables) -> DataFrame:
    success = F.col("event_type") == "purchase"
    out = cases.failures_before_success(t.events, "user_id", "ts", "event_id", success, width=86_400)
    return out.select("event_id", "user_id", F.col("failed_before").cast("bigint").alias("failed_before"))
