"""A whole validation run: do the candidates add anything to the incumbents?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from colgauge.functions.scalars import col
from colgauge.operators.blocks import value_blocks
from colgauge.operators.clean import DEFAULT_SENTINELS, FeatureSet, MissingIndicators, add_missing_indicators, clean_missing
from colgauge.operators.guards import preflight
from colgauge.operators.metrics import evaluate_predictions, new_feature_share, wide_comparison
from colgauge.plans import models, selection, verdict
from colgauge.plans.quality import QualityOptions, data_quality
from colgauge.session import materialise


@dataclass(frozen=True)
class RunOptions:
    quality: QualityOptions = QualityOptions()
    selection: selection.SelectionOptions = selection.SelectionOptions()
    fit: models.FitOptions = models.FitOptions()
    verdict: verdict.VerdictOptions = verdict.VerdictOptions()
    variants: tuple[str, ...] = ("base", "base_plus_new", "leave_one_in")
    shares: tuple[float, ...] = (0.01, 0.05, 0.10)
    sentinels: tuple[float, ...] = DEFAULT_SENTINELS
    indicators: MissingIndicators | None = None
    attribution_sample: int | None = None


@dataclass
class Run:
    """The tables of a run; those with a row per model row are lazy or on disk."""

    features: FeatureSet
    quality: DataFrame
    stats: DataFrame
    matrix: DataFrame
    selected: DataFrame
    fits: list[models.Fitted]
    predictions: DataFrame
    metrics: DataFrame
    comparison: DataFrame
    attribution: DataFrame
    new_share: DataFrame
    verdicts: DataFrame
    batch: DataFrame
    table: DataFrame | None = None      # the filled rows every fit read
    attribution_sample: int | None = None


def validate(df: DataFrame, features: FeatureSet, options: RunOptions = RunOptions()) -> Run:
    """Cleaning, checks, quality, selection, variants, metrics, attribution and verdicts.

    Result tables of a few rows per column are written as they are made, so each is
    computed once.
    """
    keep = list(dict.fromkeys([*features.id_cols, features.split, features.target, *features.all, *([features.weight] if features.weight else [])]))
    rows = clean_missing(df.select(*[col(c) for c in keep]), features.all, options.sentinels)
    if options.indicators:
        rows, features, _ = add_missing_indicators(rows, features, options.indicators)
    rows = materialise(rows, "clean")
    broken = preflight(rows, features, options.fit.task, variants=options.variants).filter("status = 'FAIL'").collect()
    if broken:
        raise ValueError("; ".join(f"{r.check}: {r.detail}" for r in broken))
    blocks = value_blocks(rows, [*features.all, features.target], features.split, features.target)
    quality, (stats, matrix), table = models.side_by_side(rows.sparkSession, [
        lambda: materialise(data_quality(rows, features, options.quality, blocks), "quality"),
        lambda: selection.measure(rows, features, options.selection, blocks),
        lambda: models.training_table(rows, features),
    ])
    selected = selection.select_features(stats, matrix, features, options.selection)
    new = list(features.new)
    if options.verdict.enforce:
        failed = {r.feature for r in quality.filter("NOT passed").collect()}
        new = [r.feature for r in selected.filter("kept").collect() if r.feature not in failed]
        new = [f for f in features.new if f in new]
    fits = models.fit_variants(table, models.build_variants(features.base, new, options.variants), options.fit)
    predictions = models.all_predictions(fits)
    metrics = materialise(evaluate_predictions(predictions, options.shares), "metrics")
    comparison = wide_comparison(metrics, shares=options.shares)
    explained = [f for f in fits if options.verdict.attribution_variant == "leave_one_in" or f.variant.name in ("base", options.verdict.attribution_variant)]
    attribution = models.mean_attribution(explained, table, sample_size=options.attribution_sample)
    evidence = verdict.candidate_evidence(list(features.new), quality, selected, comparison, attribution, options.verdict)
    verdicts = materialise(verdict.candidate_verdicts(evidence, options.verdict), "verdicts")
    return Run(
        features, quality, stats, matrix, selected, fits, predictions, metrics, comparison, attribution,
        new_feature_share(attribution, features.new), verdicts, verdict.decide_batch(verdicts, comparison, options.verdict), table,
        options.attribution_sample,
    )


def every_attribution(run: Run) -> DataFrame:
    """The attribution of every model of a run: the run explains those its verdicts read, the others are explained here."""
    if run.table is None:
        return run.attribution
    known = {r.variant for r in run.attribution.select("variant").distinct().collect()}
    rest = [f for f in run.fits if f.variant.name not in known]
    if not rest:
        return run.attribution
    return run.attribution.unionByName(models.mean_attribution(rest, run.table, sample_size=run.attribution_sample))


def evaluation_results(run: Run, feature_stats: DataFrame, split: str = "test") -> DataFrame:
    """One row per variant but base: its gains, score level, its feature's own statistics and verdict, and who carries its model.

    ``new_ranks`` has the place and share of each candidate in the variant's attribution, the first first; the base column that the feature
    moves with most has its place in base and in the variant. Candidates without a model of their own are listed with the reason.
    """
    from colgauge.operators.metrics import score_level

    feature = F.when(F.col("variant").startswith("loi__"), F.regexp_replace("variant", "^loi__", ""))
    trained = run.comparison.filter(F.col("variant") != "base").select(
        "variant", feature.alias("feature"), *[c for c in run.comparison.columns if c.endswith(f"_{split}")], F.lit(True).alias("trained"))
    spark = run.comparison.sparkSession
    asked = spark.createDataFrame([(f"loi__{f}", f) for f in run.features.new], "variant string, feature string")
    absent = asked.join(trained.select("variant"), "variant", "left_anti").withColumn("trained", F.lit(False))
    rows = trained.unionByName(absent, allowMissingColumns=True)
    judged = run.verdicts.select("feature", "verdict", "failed_at", "reason")
    level = score_level(run.predictions, split=split)
    ranks = materialise(verdict.attribution_ranks(every_attribution(run)), "attribution-ranks")
    near = ranks.filter("variant = 'base'").select(F.col("feature").alias("max_corr_with"), F.col("attr_rank").alias("nearest_rank_in_base"))
    here = ranks.select("variant", F.col("feature").alias("max_corr_with"), F.col("attr_rank").alias("nearest_rank_in_variant"))
    entry = F.struct(F.col("attr_rank").alias("rank"), "feature", F.col("n_ranked").alias("of"), F.col("attr_share").alias("share"))
    new = ranks.filter(F.col("feature").isin(*run.features.new)).groupBy("variant").agg(F.array_sort(F.collect_list(entry)).alias("new_ranks"))
    why = F.when(~F.col("trained"), F.concat(F.lit("not trained: dropped at "), F.coalesce(F.nullif("failed_at", F.lit("")), F.lit("selection"))))
    return (
        rows.join(judged, "feature", "left").join(level, "variant", "left").join(feature_stats, "feature", "left")
        .join(near, "max_corr_with", "left").join(here, ["variant", "max_corr_with"], "left").join(new, "variant", "left")
        .withColumn("not_trained", why)
    )


def evaluate_together(
    run: Run, df: DataFrame, which: str = "passing", options: RunOptions = RunOptions()
) -> DataFrame | None:
    """Base against base with all candidates, or with the passing ones, in one model; None below two.

    ``df`` holds the run's rows, as does the run's own table, which is read where the run kept it; what the
    run fitted on the same features with the same options is neither fitted nor, for the same shares, scored again.
    """
    chosen: Sequence[str] = run.features.new
    if which == "passing":
        passed = {r.feature for r in run.verdicts.filter("verdict = 'PASS'").collect()}
        chosen = [f for f in run.features.new if f in passed]
    if len(chosen) < 2:
        return None
    table = run.table
    if table is None:
        table = models.training_table(clean_missing(df, run.features.all, options.sentinels), run.features)
    name = "all_passing" if which == "passing" else "all_new"
    variants = models.build_variants(run.features.base, run.features.new, ("base",), {name: list(chosen)})
    known = {v.name: f for v in variants for f in run.fits if f.variant.features == v.features and f.options == options.fit}
    scored = {f"capture_rate_{p:g}" for p in options.shares} <= set(run.metrics.columns)
    fits = models.fit_variants(table, [v for v in variants if v.name not in known], options.fit)
    named = [replace(f, predictions=f.predictions.withColumn("variant", F.lit(name))) for name, f in known.items()]
    asked = fits if scored else named + fits
    found = [run.metrics.filter(F.col("variant") == f.variant.name).withColumn("variant", F.lit(name)) for name, f in known.items()] if scored else []
    if asked:
        found.append(evaluate_predictions(models.all_predictions(asked), options.shares))
    parts = [part.select(*[col(c) for c in found[-1].columns]) for part in found]
    return wide_comparison(materialise(reduce(DataFrame.unionByName, parts), "together-metrics"), shares=options.shares)
