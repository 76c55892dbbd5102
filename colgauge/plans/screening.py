"""One proposed feature against the incumbents: the cheap checks first, a fit last."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from colgauge.operators import guards, ranks
from colgauge.plans import models
from colgauge.plans.verdict import screen_gate


@dataclass(frozen=True)
class ScreenOptions:
    same_limit: float = ranks.REBUILT
    max_model_rho: float = 0.9
    keep_if_residual_rho: float = 0.05
    min_variable_gini: float | None = None
    redundancy_limit: float | None = None
    min_gini_gain: float = 0.0
    min_capture_gain: float | None = None
    spike_factor: float = guards.SPIKE_FACTOR
    fit: models.FitOptions = models.FitOptions(rounds=10)


COLUMNS = (
    "feature string, stage string, verified boolean, reason string, coverage double, nearest string, max_model_rho double, "
    "residual_rho double, variable_gini double, gini_gain double, capture_gain double"
)


def check_cascade(
    df: DataFrame, id_col: str, feature: str, base: Sequence[str], target: str, earlier: Sequence[str] = (),
    prediction: str | None = None, options: ScreenOptions = ScreenOptions(), fit: bool = True,
    table: DataFrame | None = None, fitted_base: models.Fitted | None = None,
) -> DataFrame:
    """One row: the stage a feature stopped at, and why; nothing after that stage is run.

    C0 the same values as an earlier feature, C1 a near copy of a model column (let
    through when it tracks the residual of ``prediction`` on valid rows, unless it is a
    rebuilt copy), C2 too weak alone, C3 the guards and then the gain of a fit.
    ``df`` holds the train and valid rows of the screen in its ``split`` column. Features of the same rows can share
    ``table``, a training table that holds them all, and ``fitted_base``, its :func:`~colgauge.plans.models.screen_base`.
    """
    spark = df.sparkSession
    out: dict[str, object] = {"feature": feature, "stage": "", "verified": False, "reason": ""}
    out["coverage"] = df.agg(F.avg(F.col(feature).isNotNull().cast("double"))).first()[0]

    def stop(stage: str, reason: str) -> DataFrame:
        out.update(stage=stage, reason=reason)
        return done()

    def done() -> DataFrame:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        return spark.createDataFrame([tuple(out.get(n) for n in names)], COLUMNS)

    for other in earlier:
        same = ranks.same_values(df, id_col, feature, other, options.same_limit).first()
        if same.same:
            return stop("C0", f"identical to `{other}` (rank correlation {same.rho:+.3f})")
    if prediction is not None:
        residual = ranks.residual_rho(df.filter("split = 'valid'"), id_col, [feature], target, prediction).first()
        out["residual_rho"] = residual.residual_rho if residual else None
    near = ranks.nearest_column(df, id_col, [feature], base).first()
    if near is not None:
        out.update(nearest=near.nearest, max_model_rho=near.max_abs_rho)
        tracks = out.get("residual_rho") is not None and abs(out["residual_rho"]) >= options.keep_if_residual_rho
        if near.max_abs_rho > options.max_model_rho and not (tracks and near.max_abs_rho < ranks.REBUILT):
            return stop("C1", f"explained by the model: |rho| {near.max_abs_rho:.2f} with the model column `{near.nearest}`")
    out["variable_gini"] = ranks.variable_gini(df, [feature], target).first().variable_gini
    if options.min_variable_gini is not None and out["variable_gini"] is not None and out["variable_gini"] < options.min_variable_gini:
        return stop("C2", f"no signal: the feature alone has a Gini of {out['variable_gini']:.3f}")
    bad = guards.check_finite(df, feature, id_col).first()
    if bad.n_bad:
        return stop("C3", f"{bad.n_bad} values are not finite, e.g. {', '.join(bad.examples)}")
    for r in guards.check_scale(df, feature, factor=options.spike_factor).filter("spike = 1").collect():
        return stop("C3", f"spikes on {r.split}: largest magnitude {r.largest:.6g} against {r.bulk:.6g}")
    if options.redundancy_limit is not None:
        r = guards.check_redundancy(df, id_col, feature, base, options.redundancy_limit).first()
        if r is not None and r.redundant:
            return stop("C3", f"redundant: |rho|={r.max_abs_rho:.3f} against the existing column '{r.nearest}'")
    if not fit:
        out.update(stage="checked", verified=True)
        return done()
    from colgauge.operators.clean import FeatureSet

    if table is None:
        table = models.training_table(df, FeatureSet(target, tuple(base), (feature,), (id_col,)))
    gain = models.screen_gain(table, base, feature, options.fit, fitted_base=fitted_base).first()
    out.update(gini_gain=gain.gini_gain, capture_gain=gain.capture_gain)
    judged = spark.createDataFrame([(gain.gini_gain, gain.capture_gain)], "g double, c double").select(
        screen_gate(F.col("g"), F.col("c"), options.min_gini_gain, options.min_capture_gain).alias("why")).first()
    if judged.why:
        return stop("gate", judged.why)
    out.update(stage="passed", verified=True)
    return done()
