"""Registered queries over selection, models, verdicts, user features and streams."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from colgauge.operators import aggregate as agg, cases, linkage as link, metrics, ranks, representative
from colgauge.operators.clean import FeatureSet
from colgauge.plans import models, quality, screening, selection, validation, verdict
from colgauge.plans.featurebook import FeatureBook, row_expression
from colgauge.plans.rank_queries import (
    BASE, CODED_SQL, FEATURE_SQL, NEW, PAIRS, RANKED_SQL, _pair_rows, feature_rows, mi_sql, psi_sql, rank_sql,
)
from colgauge.plans.registry import BASE_SQL, MODEL_SQL, Tables, day_text, history, model_rows, query, rnd
from colgauge.plans.table_queries import FEATURES
from colgauge.session import materialise
from colgauge.streaming import links

FIT = models.FitOptions(rounds=8, depth=3)


# ---- quality and selection ----
QUALITY_SQL = f"""{FEATURE_SQL}, {psi_sql([*BASE, *NEW], 'split', 'train', 'feat')},
pm AS (SELECT feature, max(psi) AS psi_max FROM ps GROUP BY 1),
pr AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, avg(CAST({c} IS NULL AS INTEGER)) AS miss, count(DISTINCT {c}) AS n_unique FROM feat WHERE split = 'train'" for c in [*BASE, *NEW])}),
q AS (SELECT pr.feature, miss, n_unique, psi_max, concat_ws(', ', CASE WHEN miss > 0.3 THEN 'missing_rate > 0.3' END,
  CASE WHEN n_unique < 30 THEN 'n_unique < 30' END, CASE WHEN psi_max > 0.25 THEN 'psi_max > 0.25' END) AS failed_checks
  FROM pr JOIN pm ON pr.feature = pm.feature)"""
STRICT = quality.QualityOptions(max_missing_rate=0.3, min_unique=30)


@query("data_quality", f"{QUALITY_SQL} SELECT feature, round(miss, 6) AS missing_rate, n_unique, round(psi_max, 6) AS psi_max, "
       "failed_checks, CAST(failed_checks = '' AS INTEGER) AS passed FROM q")
def data_quality(t: Tables) -> DataFrame:
    out = quality.data_quality(feature_rows(t), FEATURES, STRICT)
    return out.select("feature", rnd("missing_rate").alias("missing_rate"), "n_unique", rnd("psi_max").alias("psi_max"),
                      "failed_checks", F.col("passed").cast("int").alias("passed"))


@query("failed_by_check", f"{QUALITY_SQL} SELECT c AS \"check\", count(*) AS n FROM (SELECT unnest(string_split(failed_checks, ', ')) AS c FROM q WHERE failed_checks <> '') GROUP BY 1")
def failed_by_check(t: Tables) -> DataFrame:
    return quality.failed_by_check(quality.data_quality(feature_rows(t), FEATURES, STRICT))


SEL_PAIRS = [(a, b) for a in NEW for b in [*BASE, "y"]]
STATS_SQL = f"""{CODED_SQL}, rk AS (SELECT {', '.join(f'{rank_sql(c)} AS {c}' for c in [*BASE, *NEW, 'y'])} FROM tr),
rho AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature, '{b}' AS other, corr({a}, {b}) AS rho FROM rk" for a, b in SEL_PAIRS)}),
{mi_sql(SEL_PAIRS)}, nm AS (SELECT feature, other, mi, CASE WHEN least(ha, hb) > 0 THEN mi / least(ha, hb) END AS nmi FROM h)"""


@query("selection_stats", f"""{STATS_SQL} SELECT r.feature, round(max(r.rho) FILTER (r.other = 'y'), 6) + 0.0 AS spearman_target,
  round(max(n.mi) FILTER (n.other = 'y'), 6) AS mi_target, round(max(n.nmi) FILTER (n.other = 'y'), 6) AS nmi_target,
  round(max(abs(r.rho)) FILTER (r.other <> 'y'), 6) AS spearman_redundancy_base,
  round(max(n.nmi) FILTER (n.other <> 'y'), 6) AS mi_redundancy_base,
  round(max(n.nmi) FILTER (n.other = 'y') - max(n.nmi) FILTER (n.other <> 'y'), 6) + 0.0 AS mrmr_score
FROM rho r JOIN nm n ON r.feature = n.feature AND r.other = n.other GROUP BY 1""")
def selection_stats(t: Tables) -> DataFrame:
    stats, _ = selection.measure(feature_rows(t), FEATURES)
    return stats.select("feature", *[rnd(c).alias(c) for c in stats.columns if c != "feature"])


SELECT_SQL = f"""WITH RECURSIVE {RANKED_SQL.removeprefix('WITH ')},
pr AS ({_pair_rows(PAIRS)}), ty AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature, corr({a}, ry) AS rho FROM rk" for a in NEW)}),
o AS (SELECT feature, list({{'other': pr.other, 'size': abs(pr.rho)}}) AS near FROM pr GROUP BY 1),
weak AS (SELECT feature FROM ty WHERE coalesce(abs(rho), 0) < 0.002),
ord AS (SELECT o.*, row_number() OVER (ORDER BY abs(ty.rho) DESC) AS k FROM o JOIN ty USING (feature) WHERE feature NOT IN (FROM weak)),
g AS (SELECT 0::BIGINT AS k, [{', '.join(f"'{b}'" for b in BASE)}] AS taken, '' AS feature, TRUE AS kept
  UNION ALL SELECT ord.k, CASE WHEN over THEN taken ELSE list_append(taken, ord.feature) END, ord.feature, NOT over
  FROM (SELECT g.k + 1 AS k, g.taken, coalesce(list_max(list_transform(list_filter(x.near, lambda n: list_contains(g.taken, n.other)), lambda n: n.size)), 0) > 0.5 AS over
        FROM g JOIN ord x ON x.k = g.k + 1) s JOIN ord ON ord.k = s.k)
SELECT feature, CASE WHEN kept THEN 'IN' ELSE 'OUT' END AS verdict, CASE WHEN kept THEN '-' ELSE 'redundancy screen' END AS decided_by,
  round(rho, 6) + 0.0 AS spearman_target FROM g JOIN ty USING (feature) WHERE k > 0
UNION ALL SELECT feature, 'OUT', 'signal screen', round(rho, 6) + 0.0 FROM weak JOIN ty USING (feature)"""


@query("select_features", SELECT_SQL)
def select_features(t: Tables) -> DataFrame:
    """The greedy pass over measured candidates, then IN or OUT with what decided it."""
    options = selection.SelectionOptions(target_min_abs=0.002, max_abs_rho=0.5)
    rows = feature_rows(t)
    stats, matrix = selection.measure(rows, FEATURES, options)
    selected = selection.select_features(stats, matrix, FEATURES, options)
    out = selection.selection_verdicts(selected, stats, None, NEW)
    return out.select("feature", "verdict", "decided_by", rnd("spearman_target").alias("spearman_target"))


# ---- verdicts: one candidate per part, with evidence read off its sales ----
EVIDENCE_SQL = """ev AS (SELECT l_partkey AS p, count(*) AS n, avg(l_discount) AS d, avg(l_tax) AS x, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
e AS (SELECT CAST(p AS VARCHAR) AS feature, n % 7 <> 0 AS quality_passed, n % 5 <> 0 AS kept,
  CASE WHEN n % 3 = 0 THEN NULL ELSE round(d - 0.045, 6) END AS gain, row_number() OVER (ORDER BY q DESC, CAST(p AS VARCHAR)) AS attr_rank, count(*) OVER () AS n_ranked FROM ev),
g AS (SELECT feature, gain, CASE WHEN quality_passed THEN 'PASS' ELSE 'FAIL' END AS g1, CASE WHEN kept THEN 'PASS' ELSE 'FAIL' END AS g2,
  CASE WHEN gain IS NULL THEN 'not evaluable' WHEN gain >= 0.005 THEN 'PASS' ELSE 'FAIL' END AS g3,
  CASE WHEN attr_rank / n_ranked <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS g4 FROM e),
v AS (SELECT feature, gain, g1, CASE WHEN g1 = 'FAIL' THEN 'not reached' ELSE g2 END AS g2,
  CASE WHEN g1 = 'FAIL' OR g2 = 'FAIL' THEN 'not reached' ELSE g3 END AS g3,
  CASE WHEN g1 = 'FAIL' OR g2 = 'FAIL' OR g3 = 'FAIL' THEN 'not reached' ELSE g4 END AS g4 FROM g),
vv AS (SELECT *, CASE WHEN g1 = 'FAIL' THEN 'data quality' WHEN g2 = 'FAIL' THEN 'feature selection' WHEN g3 = 'FAIL' THEN 'gini gain'
  WHEN g4 = 'FAIL' THEN 'attribution rank' ELSE '' END AS failed_at FROM v)"""


def _part_evidence(t: Tables) -> DataFrame:
    from colgauge.operators.order import running_totals

    parts = t.lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("d"), F.sum("l_quantity").alias("mean_abs_attr"))
    named = parts.select(
        F.col("l_partkey").cast("string").alias("feature"), (F.col("n") % 7 != 0).alias("quality_passed"), (F.col("n") % 5 != 0).alias("kept"),
        F.lit("redundancy screen").alias("decided_by"), F.lit("redundant").alias("reason"),
        F.when(F.col("n") % 3 != 0, rnd(F.col("d") - 0.045)).alias("gain"), F.lit(None).cast("double").alias("gain_valid"), "mean_abs_attr")
    sums = named.groupBy(F.lit("all").alias("g"), F.col("mean_abs_attr").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    placed = running_totals(sums, ["g"], "value", ["n"], descending=True).select(F.col("value").alias("mean_abs_attr"), "n_before", "n_total")
    ties = Window.partitionBy("mean_abs_attr").orderBy("feature")
    return named.join(placed, "mean_abs_attr").withColumns({
        "attr_rank": (F.col("n_before") + F.row_number().over(ties)).cast("int"), "n_ranked": F.col("n_total")})


ENFORCED = verdict.VerdictOptions(enforce=True)


@query("candidate_verdicts", f"""WITH {EVIDENCE_SQL} SELECT feature, CASE WHEN failed_at = '' THEN 'PASS' ELSE 'FAIL' END AS verdict, failed_at,
  g1 AS data_quality, g2 AS feature_selection, g3 AS gini_gain, g4 AS attribution_rank FROM vv""")
def candidate_verdicts(t: Tables) -> DataFrame:
    out = verdict.candidate_verdicts(_part_evidence(t), ENFORCED)
    return out.select("feature", "verdict", "failed_at", "data_quality", "feature_selection", "gini_gain", "attribution_rank")


@query("failed_at_counts", f"WITH {EVIDENCE_SQL} SELECT failed_at, count(*) AS n FROM vv WHERE failed_at <> '' GROUP BY 1")
def failed_at_counts(t: Tables) -> DataFrame:
    return verdict.failed_at_counts(verdict.candidate_verdicts(_part_evidence(t), ENFORCED))


@query("decide_batch", f"""WITH {EVIDENCE_SQL} SELECT CASE WHEN count(*) FILTER (failed_at = '') > 0 THEN 'KEEP' ELSE 'TRY A NEW BATCH' END AS verdict,
  count(*) AS n_candidates, count(*) FILTER (failed_at = '') AS n_passed FROM vv""")
def decide_batch(t: Tables) -> DataFrame:
    return verdict.decide_batch(verdict.candidate_verdicts(_part_evidence(t), ENFORCED)).select("verdict", "n_candidates", "n_passed")


@query("decide_batch_columns", f"""WITH {EVIDENCE_SQL}, parts AS (SELECT 'all' AS part, * FROM vv UNION ALL SELECT 'stopped' AS part, * FROM vv WHERE failed_at <> ''),
w AS (SELECT part, failed_at AS gate FROM parts WHERE failed_at <> '' GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY count(*) DESC, list_position(['data quality', 'feature selection', 'gini gain', 'attribution rank'], failed_at)) = 1),
n AS (SELECT part, count(*) AS n_candidates, count(*) FILTER (failed_at = '') AS n_passed, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (failed_at = ''), '') AS passed FROM parts GROUP BY 1)
SELECT part, CASE WHEN n_passed > 0 THEN 'KEEP' ELSE 'TRY A NEW BATCH' END AS verdict, n_candidates, n_passed, passed, CASE WHEN n_passed > 0 THEN '' ELSE gate END AS worst_gate,
  CASE WHEN n_passed > 0 THEN n_passed || ' candidates cleared every gate' ELSE 'every candidate was stopped, most often at: ' || gate END AS note FROM n LEFT JOIN w USING (part)""")
def decide_batch_columns(t: Tables) -> DataFrame:
    """Every column of the decision, over all candidates and over those that were stopped."""
    judged = materialise(verdict.candidate_verdicts(_part_evidence(t), ENFORCED), "judged")
    parts = {"all": judged, "stopped": judged.filter(F.col("verdict") == "FAIL")}
    all_parts, stopped = (verdict.decide_batch(v).select(
        F.lit(part).alias("part"), "verdict", "n_candidates", "n_passed", F.array_join("passed", ",").alias("passed"), "worst_gate", "note",
    ) for part, v in parts.items())
    return all_parts.unionByName(stopped)


@query("screen_gate", """SELECT event_id, CASE WHEN value / 1000 - 0.05 > 0.005 AND user_id / 1000 > 0.02 THEN 1 ELSE 0 END AS passed FROM events""")
def screen_gate(t: Tables) -> DataFrame:
    why = verdict.screen_gate(F.col("value") / 1000 - 0.05, F.col("user_id") / 1000, 0.005, 0.02)
    return t.events.select("event_id", (why == "").cast("int").alias("passed"))


# ---- models ----
def _table(t: Tables) -> DataFrame:
    return models.training_table(feature_rows(t), FEATURES)


@query("fit_variants", f"{FEATURE_SQL}, v AS (SELECT unnest(['base', 'base_plus_new', 'loi__returned']) AS variant) SELECT variant, split, count(*) AS n_rows, "
       "CAST(sum(y) AS BIGINT) AS positives, 1 AS scored FROM feat, v GROUP BY 1, 2")
def fit_variants(t: Tables) -> DataFrame:
    """Three variants fitted and every row scored; the scores are between 0 and 1."""
    variants = models.build_variants(BASE, NEW, ("base", "base_plus_new", "leave_one_in"), single=["returned"])
    pred = models.all_predictions(models.fit_variants(_table(t), variants, FIT))
    return pred.groupBy("variant", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y").cast("bigint").alias("positives"), F.min(F.col("score").between(0, 1)).cast("int").alias("scored"))


@query("screen_gain")
def screen_gain(t: Tables) -> DataFrame:
    return models.screen_gain(_table(t), BASE, "returned", FIT)


@query("random_search")
def random_search(t: Tables) -> DataFrame:
    variants = models.build_variants(BASE, NEW)
    return models.random_search(_table(t), variants, models.FitOptions(rounds=4), trials=2)[1]


@query("attribution")
def attribution(t: Tables) -> DataFrame:
    table = _table(t)
    fits = models.fit_variants(table, models.build_variants(BASE, NEW, ("base_plus_new",)), FIT)
    ranked = verdict.attribution_ranks(models.mean_attribution(fits, table))
    return link.merge_rankings(ranked, models.importance_table(fits))


@query("new_feature_share", """WITH a AS (SELECT l_returnflag AS variant, CAST(l_linenumber AS VARCHAR) AS feature, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2)
SELECT variant, round(sum(m) FILTER (feature IN ('6', '7')) / sum(m), 6) AS new_share FROM a GROUP BY 1""")
def new_feature_share(t: Tables) -> DataFrame:
    table = t.lineitem.groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").cast("string").alias("feature")).agg(
        F.avg("l_quantity").alias("mean_abs_attr"))
    return metrics.new_feature_share(table, ["6", "7"]).withColumn("new_share", rnd("new_share"))


@query("reuse_base", "SELECT 0 AS first_time, 1 AS second_time, count(*) AS n_rows, 0 AS differing FROM orders")
def reuse_base(t: Tables) -> DataFrame:
    """The baseline fitted and kept, then found again for the same rows and settings."""
    from colgauge.session import scratch_path

    table, folder = _table(t), scratch_path(t.spark, "base-models")
    base = models.build_variants(BASE, NEW, ("base",))[0]
    first, fresh = models.reuse_base(table, base, folder, FIT)
    again, kept = models.reuse_base(table, base, folder, FIT)
    both = first.predictions.select("id", F.col("score").alias("a")).join(again.predictions.select("id", F.col("score").alias("b")), "id")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("a") != F.col("b")).alias("differing")).select(
        F.lit(int(fresh)).alias("first_time"), F.lit(int(kept)).alias("second_time"), "n_rows", "differing")


@query("score_cases", f"WITH {MODEL_SQL}, v AS (SELECT unnest(['base', 'base_plus_new']) AS variant) SELECT variant, key, count(*) AS n_rows FROM model, v GROUP BY 1, 2")
def score_cases(t: Tables) -> DataFrame:
    """Each customer's orders are the rows of a case, scored by two models."""
    table, rows = _table(t), feature_rows(t)
    fits = models.fit_variants(table, models.build_variants(BASE, NEW), FIT)
    scored = models.score_cases(rows, fits, table, ["id", "key", "as_of"])
    return scored.groupBy("variant", "key").agg(F.count(F.lit(1)).alias("n_rows"))


@query("flagged_cases")
def flagged_cases(t: Tables) -> DataFrame:
    """Cases flagged by two fitted models at the score of their top tenth of test: who is sooner."""
    table = _table(t)
    rows = materialise(cases.sequence_cases(feature_rows(t), "key", "as_of", "id"), "cases")
    fits = models.fit_variants(table, models.build_variants(BASE, NEW), FIT)
    cut = {r.variant: r.cutoff for r in metrics.score_cutoffs(models.all_predictions(fits), [0.1]).collect()}
    scored = models.score_cases(rows, fits, table, ["id", "key", "as_of", "_t"])
    flags = {n: (F.col("variant") == v) & (F.col("score") >= cut[v]) for n, v in (("base", "base"), ("variant", "base_plus_new"))}
    return cases.outcome_counts(cases.flag_outcomes(cases.first_flags(scored, "key", "as_of", flags)))


@query("check_cascade")
def check_cascade(t: Tables) -> DataFrame:
    """A screened feature through its checks, down to the gain of a fit."""
    rows = materialise(feature_rows(t).filter("split <> 'test'").withColumn("pred", F.lit(0.33)), "screen-rows")
    options = screening.ScreenOptions(min_gini_gain=-1.0, fit=FIT)
    copy = rows.withColumn("copied", F.col("price") * 2 + 1)
    passed = screening.check_cascade(rows, "id", "returned", BASE, "y", prediction="pred", options=options)
    stopped = screening.check_cascade(copy, "id", "copied", BASE, "y", earlier=["price"], options=options, fit=False)
    return passed.unionByName(stopped)


RUN = validation.RunOptions(fit=FIT, quality=quality.QualityOptions(min_unique=2))


@query("validation_run")
def validation_run(t: Tables) -> DataFrame:
    """Everything in order, on the orders: quality, selection, models, attribution, verdicts."""
    return validation.validate(feature_rows(t), FEATURES, RUN).verdicts


@query("evaluation_results")
def evaluation_results(t: Tables) -> DataFrame:
    rows = feature_rows(t)
    run = validation.validate(rows, FEATURES, RUN)
    return validation.evaluation_results(run, ranks.feature_stats(rows, "id", NEW, BASE, "y"))


# ---- the same, with the answer planted among the candidates, so that what comes out is known ----
PLANTED = FeatureSet("y", tuple(BASE), ("answer", "flat"), ("id",))


def _planted(t: Tables) -> DataFrame:
    """Model rows with a candidate that equals the outcome and one that never varies."""
    return feature_rows(t).withColumns({"answer": F.col("y").cast("double"), "flat": F.lit(1.0)})


@query("screen_gain_planted", f"""WITH {MODEL_SQL} SELECT 'answer' AS feature, 1.0 AS gini,
  round(least(floor(count(*) * 0.05), sum(y)) / sum(y), 6) AS capture FROM model WHERE split = 'valid'""")
def screen_gain_planted(t: Tables) -> DataFrame:
    """A feature that is the outcome puts every event before every other row."""
    found = models.screen_gain(models.training_table(_planted(t), PLANTED), BASE, "answer", FIT)
    return found.select("feature", rnd("gini").alias("gini"), rnd("capture").alias("capture"))


@query("random_search_planted", "SELECT 'base_plus_new' AS variant, unnest([0, 1]) AS trial, 1.0 AS score")
def random_search_planted(t: Tables) -> DataFrame:
    table = models.training_table(_planted(t), PLANTED)
    log = models.random_search(table, models.build_variants(BASE, PLANTED.new), models.FitOptions(rounds=4), trials=2)[1]
    return log.select("variant", "trial", rnd("score").alias("score"))


@query("attribution_planted", """SELECT unnest(['answer', 'flat', 'price', 'acctbal', 'nation']) AS feature, unnest([1.0, 0.0, 0.0, 0.0, 0.0]) AS attr_share,
  unnest([1.0, 0.0, 0.0, 0.0, 0.0]) AS importance_share, unnest([TRUE, FALSE, FALSE, FALSE, FALSE]) AS first""")
def attribution_planted(t: Tables) -> DataFrame:
    """The outcome among the features takes all of the attribution and of the importance."""
    table = models.training_table(_planted(t), PLANTED)
    fits = models.fit_variants(table, models.build_variants(BASE, PLANTED.new, ("base_plus_new",)), FIT)
    both = link.merge_rankings(verdict.attribution_ranks(models.mean_attribution(fits, table)), models.importance_table(fits))
    return both.select("feature", rnd("attr_share").alias("attr_share"), rnd("importance_share").alias("importance_share"), (F.col("attr_rank") == 1).alias("first"))


@query("check_cascade_planted", f"""WITH {MODEL_SQL} SELECT 'answer' AS feature, 'passed' AS stage, TRUE AS verified, 1.0 AS coverage, 1.0 AS variable_gini
UNION ALL SELECT 'copied', 'C0', FALSE, round(avg(CAST(price IS NOT NULL AS INT)), 6), NULL FROM model WHERE split <> 'test'
UNION ALL SELECT 'flat', 'gate', FALSE, 1.0, NULL""")
def check_cascade_planted(t: Tables) -> DataFrame:
    """The outcome clears every check, a copy stops at the first and a constant at the gate."""
    rows = materialise(_planted(t).filter("split <> 'test'").withColumn("copied", F.col("price") * 2 + 1), "screen-rows")
    options = screening.ScreenOptions(fit=FIT)
    table = models.training_table(rows, PLANTED)
    shared = {"table": table, "fitted_base": models.screen_base(table, BASE, FIT)}
    out = screening.check_cascade(rows, "id", "answer", BASE, "y", options=options, **shared)
    out = out.unionByName(screening.check_cascade(rows, "id", "copied", BASE, "y", earlier=["price"], options=options, fit=False))
    out = out.unionByName(screening.check_cascade(rows, "id", "flat", BASE, "y", options=options, **shared))
    return out.select("feature", "stage", "verified", rnd("coverage").alias("coverage"), rnd("variable_gini").alias("variable_gini"))


@query("validation_planted", """SELECT 'answer' AS feature, 'PASS' AS verdict, '' AS failed_at, 'KEEP' AS batch, 1.0 AS adj_gini_test
UNION ALL SELECT 'flat', 'FAIL', 'data quality', 'KEEP', 1.0""")
def validation_planted(t: Tables) -> DataFrame:
    """A whole run keeps the outcome, stops the constant, and finds a perfect model with both."""
    run = validation.validate(_planted(t), PLANTED, RUN)
    gini = run.metrics.filter("variant = 'base_plus_new' AND split = 'test'").agg(F.max("adj_gini")).scalar()
    return run.verdicts.select(
        "feature", "verdict", "failed_at", run.batch.agg(F.max("verdict")).scalar().alias("batch"), rnd(gini).alias("adj_gini_test"))


@query("evaluation_results_planted", """SELECT 'loi__answer' AS variant, 'answer' AS feature, TRUE AS trained, 1.0 AS adj_gini_test, 'PASS' AS verdict, 'base, combo__all_new' AS together""")
def evaluation_results_planted(t: Tables) -> DataFrame:
    """The planted candidate's own model and verdict; beside it the variants of one model of all candidates."""
    rows = _planted(t)
    run = validation.validate(rows, PLANTED, RUN)
    both = validation.evaluate_together(run, rows, "all", RUN)
    # One row for each variant.
    names = ", ".join(sorted(r.variant for r in both.select("variant").collect()))
    out = validation.evaluation_results(run, ranks.feature_stats(rows, "id", PLANTED.new, BASE, "y"))
    return out.filter("feature = 'answer'").select(
        "variant", "feature", "trained", rnd("adj_gini_test").alias("adj_gini_test"), "verdict", F.lit(names).alias("together"))


@query("feature_stats", f"""{FEATURE_SQL}, rk AS (SELECT {', '.join(f'{rank_sql(c)} AS {c}' for c in [*BASE, *NEW])} FROM feat WHERE split = 'train'),
p AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature, '{b}' AS other, abs(corr({a}, {b})) AS rho FROM rk" for a in NEW for b in BASE)}),
m AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature, avg(CAST({a} IS NULL AS INTEGER)) AS miss FROM feat" for a in NEW)}),
l AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature, split, y, {a} AS x FROM feat" for a in NEW)}),
v AS (SELECT feature, y, coalesce(x, quantile_cont(x, 0.5) OVER (PARTITION BY feature)) AS v FROM l WHERE split = 'test'),
vr AS (SELECT feature, y, v, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM v),
vs AS (SELECT feature, sum(r) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y <> 1) AS n0, count(DISTINCT v) AS levels FROM vr GROUP BY 1),
g AS (SELECT feature, CASE WHEN levels > 1 AND n1 > 0 AND n0 > 0 THEN abs(2 * (sr - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * n0) - 1) END AS gini FROM vs),
st AS (SELECT feature, split, min(x) <> max(x) AS varied, CASE WHEN count(x) = 0 THEN 'empty'
  WHEN min(x) = max(x) THEN 'one value (' || regexp_replace(CAST(round(min(x), 6) AS VARCHAR), '[.]0$', '') || ')' END AS state FROM l GROUP BY 1, 2),
w AS (SELECT feature, max(state) FILTER (split = 'test') || CASE WHEN max(state) FILTER (split = 'valid') IS NULL THEN ' on test' ELSE ' on valid and test' END
  || CASE WHEN bool_or(varied) FILTER (split = 'train') THEN '; it does vary on train, so its source may end too early' ELSE '' END AS why FROM st GROUP BY 1)
SELECT p.feature, round(any_value(miss), 6) AS missing_rate, round(max(rho), 6) AS max_corr, max_by(other, rho) AS max_corr_with,
  round(any_value(gini), 6) + 0.0 AS variable_gini, CASE WHEN any_value(gini) IS NULL THEN coalesce(any_value(why), 'no signal on test') END AS variable_gini_note
FROM p JOIN m ON p.feature = m.feature LEFT JOIN g ON p.feature = g.feature LEFT JOIN w ON p.feature = w.feature GROUP BY 1""")
def feature_stats(t: Tables) -> DataFrame:
    out = ranks.feature_stats(feature_rows(t), "id", NEW, BASE, "y")
    return out.select(
        "feature", rnd("missing_rate").alias("missing_rate"), rnd("max_corr").alias("max_corr"), "max_corr_with",
        rnd("variable_gini").alias("variable_gini"), "variable_gini_note")


@query("evaluate_together")
def evaluate_together(t: Tables) -> DataFrame:
    rows = feature_rows(t)
    run = validation.validate(rows, FEATURES, RUN)
    return validation.evaluate_together(run, rows, "all", RUN)


# ---- representative rows ----
@query("representative_rows", "SELECT label, b AS batch, count(*) AS n FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest(range(2)) AS b), (SELECT unnest(range(greatest(1, CAST(floor(20 / (SELECT count(DISTINCT label) FROM embeddings)) AS INTEGER)))) AS c) GROUP BY 1, 2")
def representative_rows(t: Tables) -> DataFrame:
    """Two batches of the embeddings, as many rows of each label as it has clusters."""
    vectors = t.embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("encoded"))
    picked = representative.representative_rows(vectors, "vec_id", "label", shots=20, batches=2, rounds=10)
    return picked.groupBy("label", "batch").agg(F.count(F.lit(1)).alias("n"))


def _assign(rows: str, centres: str) -> str:
    return f"SELECT vec_id, label, x, cluster, power(list_distance(x, c), 2) AS d FROM {rows} JOIN {centres} USING (label) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1"


def _means(rows: str) -> str:
    return f"SELECT label, cluster, list(m ORDER BY i) AS c FROM (SELECT label, cluster, i, avg(x[i]) AS m FROM {rows}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM v))) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2"


@query("grouped_kmeans", f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL),
c0 AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS cluster, x AS c FROM v QUALIFY cluster <= 3),
a0 AS ({_assign("v", "c0")}), c1 AS ({_means("a0")}), a1 AS ({_assign("v", "c1")}), c2 AS ({_means("a1")}), a2 AS ({_assign("v", "c2")})
SELECT vec_id, label, CAST(cluster AS INTEGER) AS cluster, round(d, 4) + 0.0 AS distance FROM a2""")
def grouped_kmeans(t: Tables) -> DataFrame:
    """Two rounds of Lloyd in every label at once, from its three first vectors: each row's cluster and squared distance."""
    vectors = t.embeddings.filter("label IS NOT NULL").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("encoded"))
    first = Window.partitionBy("label").orderBy("vec_id")
    start = vectors.withColumn("cluster", F.row_number().over(first)).filter("cluster <= 3").select(
        "label", "cluster", vector_to_array("encoded").alias("centre"))
    centres = representative.grouped_kmeans(vectors, "label", start, rounds=2)
    return representative.nearest_centres(vectors, "label", centres).select(
        "vec_id", "label", "cluster", rnd("distance", 4).alias("distance"))


@query("encode_for_clustering", f"""{FEATURE_SQL}, m AS (SELECT median(price) AS p, median(returned) AS r FROM feat),
f AS (SELECT id, price, coalesce(returned, r) AS returned FROM feat, m),
b AS (SELECT quantile_cont(price, 0.005) AS p0, quantile_cont(price, 0.995) AS p1, quantile_cont(returned, 0.005) AS r0, quantile_cont(returned, 0.995) AS r1 FROM f),
c AS (SELECT id, least(greatest(price, p0), p1) AS price, least(greatest(returned, r0), r1) AS returned FROM f, b)
SELECT id, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 5) + 0.0 AS e0, round((returned - avg(returned) OVER ()) / stddev_pop(returned) OVER (), 5) + 0.0 AS e1 FROM c""")
def encode(t: Tables) -> DataFrame:
    out = representative.encode_for_clustering(feature_rows(t), "id", ["price", "returned"], ["y"])
    e = vector_to_array("encoded")
    return out.select("id", rnd(e[0], 5).alias("e0"), rnd(e[1], 5).alias("e1"))


# ---- user features ----
@query("feature_book", f"""{BASE_SQL}, a AS (SELECT m.id, max(h.amount) AS top_amount FROM model m JOIN hist h ON m.key = h.key AND h.event_time < m.as_of GROUP BY 1),
mo AS (SELECT o_custkey AS key, last_day(CAST(o_orderdate AS DATE)) AS p, count(*) AS n FROM orders GROUP BY 1, 2),
b AS (SELECT m.id, max(mo.n) AS busiest_month FROM model m JOIN mo ON m.key = mo.key AND mo.p < m.as_of GROUP BY 1)
SELECT m.id, a.top_amount, b.busiest_month FROM model m LEFT JOIN a ON m.id = a.id LEFT JOIN b ON m.id = b.id""")
def feature_book(t: Tables) -> DataFrame:
    """A user's link, aggregate and two features, each checked, joined to the model rows."""
    ids = model_rows(t).select("id", "key", "as_of")
    book = FeatureBook(ids)
    book.register_source("orders", history(t))
    book.register_link("orders", lambda base, source: link.link_point_in_time(base, source, key="key", time="event_time"), time="event_time")
    book.register_aggregate("monthly", "orders", lambda s: s.groupBy("key", agg.PERIOD_END).agg(F.count(F.lit(1)).alias("n")), "event_time", ["key"], "month")
    book.register_feature("top_amount", lambda linked, base: linked["orders"].groupBy("id").agg(F.max("amount").alias("top_amount")))
    book.register_feature("busiest_month", lambda linked, base: linked["monthly"].groupBy("id").agg(F.max("n").alias("busiest_month")))
    return book.attach(ids.select("id"))


@query("row_expression", f"{FEATURE_SQL} SELECT id, price / nullif(qty, 0) AS unit FROM feat")
def row_expr(t: Tables) -> DataFrame:
    return row_expression(feature_rows(t), "unit", "price / nullif(qty, 0)", [*BASE, *NEW]).select("id", "unit")


# ---- streams ----
@query("stream_link", """SELECT o.o_orderkey AS id, e.event_id, e.value FROM events e JOIN orders o ON e.user_id = o.o_custkey
AND e.ts < o.o_orderdate + INTERVAL 9000 DAY""")
def stream_link(t: Tables) -> DataFrame:
    ids = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 9000 DAYS")).alias("as_of"))
    events = links.read_event_stream(t.spark, t.path("events"), t.events.schema)
    linked = links.stream_link(events, ids, key="user_id", time="ts")
    return links.run_to_folder(linked.select("id", "event_id", "value"), "stream-link")


@query("stream_period_agg", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS p, count(*) AS n, round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2)
SELECT user_id, strftime(p, '%Y-%m-%d') AS period_end, n, value_sum FROM d WHERE p <= (SELECT max(p) FROM d) - 1""")
def stream_period_agg(t: Tables) -> DataFrame:
    events = links.read_event_stream(t.spark, t.path("events"), t.events.schema)
    out = links.run_to_folder(links.stream_period_agg(events, "user_id", "ts", "day", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")]), "stream-days")
    return out.select("user_id", day_text("period_end").alias("period_end"), "n", rnd("value_sum", 4).alias("value_sum"))


