"""Data quality: which columns may go on, and which threshold stopped the others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from colgauge.functions.scalars import col
from colgauge.operators.binning import distribution_check
from colgauge.operators.blocks import block_psi, profile_blocks
from colgauge.operators.clean import FeatureSet
from colgauge.operators.profile import profile_columns


@dataclass(frozen=True)
class QualityOptions:
    max_missing_rate: float = 0.99
    min_unique: int = 2
    max_psi: float = 0.25
    reference: str = "train"
    bins: int = 10
    others: tuple[str, ...] = ("valid", "test")
    distribution: bool = True


def data_quality(
    df: DataFrame, features: FeatureSet, options: QualityOptions = QualityOptions(), blocks: DataFrame | None = None
) -> DataFrame:
    """One row per column: its profile on train, its drift, failed_checks and passed.

    A column without a drift figure does not fail the drift check. ``blocks`` of the columns, if given,
    are read in place of the rows.
    """
    found = None
    if blocks is None:
        report = profile_columns(df.filter(col(features.split) == "train"), features.all)
    else:
        report = profile_blocks(blocks, {c: t for c, t in df.dtypes if c in set(features.all)}, "train", features.split)
    if options.distribution:
        if blocks is not None:
            found = block_psi(blocks, features.all, features.split, options.reference, options.bins)
        drift = distribution_check(df, features.all, options.reference, options.others, features.split, options.bins, found)
        report = report.join(drift, "feature", "left")
    else:
        report = report.withColumn("psi_max", F.lit(None).cast("double"))
    checks = {
        f"missing_rate > {options.max_missing_rate:g}": F.col("missing_rate") > options.max_missing_rate,
        f"n_unique < {options.min_unique:g}": F.col("n_unique") < options.min_unique,
        f"psi_max > {options.max_psi:g}": F.coalesce("psi_max", F.lit(0.0)) > options.max_psi,
    }
    failed = F.concat_ws(", ", *[F.when(broken, F.lit(name)) for name, broken in checks.items()])
    return report.withColumn("failed_checks", failed).withColumn("passed", F.col("failed_checks") == "")


def failed_by_check(report: DataFrame) -> DataFrame:
    """How many columns each threshold rejected; one column can fail several."""
    return (
        report.select(F.explode(F.split("failed_checks", ", ")).alias("check"))
        .filter(F.col("check") != "").groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    )
