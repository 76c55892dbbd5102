"""What runs of proposals have shown: outcomes, standings, families, repeated reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from colgauge.functions.scalars import col
from colgauge.operators.order import running_totals
from colgauge.session import materialise
from colgauge.sources.attempts import SUCCESSES

FAILED_WEIGHT = 0.5
# Reasons that say nothing about the idea behind a feature.
NO_EVIDENCE = r"^script failed|^build\(\) returned"
SAME_COLUMN = r"against the existing column '([^']+)'|with the model column `([^`]+)`"


def outcome_rollup(attempts: DataFrame) -> DataFrame:
    """Attempts per outcome with the first of them as an example."""
    first = F.min_by(F.struct("name", "detail"), F.struct("ts", "id"))
    return attempts.groupBy("kind", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("outcome").isin(*SUCCESSES).cast("int")).alias("success"),
        first.alias("_e"),
    ).select("kind", "outcome", "n", "success", F.col("_e.name").alias("example"), F.col("_e.detail").alias("example_detail"))


def feature_evidence(verified: Column, reason: Column) -> Column:
    """'signal', 'none', or NULL when the attempt says nothing."""
    text = F.coalesce(reason, F.lit(""))
    return F.when(F.coalesce(verified, F.lit(False)), "signal").when(
        (text != "") & ~text.rlike(NO_EVIDENCE), "none"
    )


def standing(signal: Column, none: Column) -> dict[str, Column]:
    """Status and Beta parameters from counts; a miss weighs half a hit."""
    beta = 1 + FAILED_WEIGHT * none
    return {
        "status": F.when(signal > 0, "active").when(none > 0, "low").otherwise("explore"),
        "alpha": (1 + signal).cast("double"), "beta": beta.cast("double"), "p_useful": (1 + signal) / (1 + signal + beta),
    }


def evidence_standing(records: DataFrame, group: str, evidence: str = "evidence") -> DataFrame:
    """Signal and no-signal counts per group with their standing."""
    counts = records.groupBy(group).agg(
        F.count_if(col(evidence) == "signal").alias("signal"), F.count_if(col(evidence) == "none").alias("none")
    )
    return counts.withColumns(standing(F.col("signal"), F.col("none")))


def family_roots(records: DataFrame, key: str = "key", same_as: str = "same_as") -> DataFrame:
    """(key, family): each record's earliest ancestor along its ``same_as`` link.

    Records that lead into a circle of links share the circle's smallest key. Every round
    doubles the distance a record looks up, so a chain of n links takes log2(n) rounds;
    only records still on their way are written again. What has not arrived after as many
    steps as there are records goes round in a circle, and has seen all of it.
    """
    links = records.select(col(key).alias("key"), col(same_as).alias("_same"))
    known = records.select(col(key).alias("_same"))
    rooted = links.join(known, "_same", "left_semi").select("key", F.col("_same").alias("up"))
    loose = links.join(rooted.select("key"), "key", "left_anti")
    settled = materialise(loose.select("key", F.col("key").alias("up"), F.lit(True).alias("done")), "families")
    active = materialise(rooted.withColumns({"done": F.lit(False), "low": F.col("up")}), "families")
    steps, waiting = 1, active.count()
    reach = waiting
    while waiting and steps <= 2 * reach:
        above = settled.withColumn("low", F.col("key")).unionByName(active).select(
            F.col("key").alias("up"), F.col("up").alias("_up"), F.col("done").alias("_done"), F.col("low").alias("_low"))
        moved = materialise(active.join(above, "up").select(
            "key", F.col("_up").alias("up"), F.col("_done").alias("done"), F.least("low", "_low").alias("low")), "families")
        settled = settled.unionByName(moved.filter("done").drop("low"))
        active, steps = moved.filter("NOT done"), 2 * steps
        waiting = active.count()
    round_ = active.select(F.col("key").alias("up"), F.col("low").alias("family"))
    circles = active.join(round_, "up").select("key", "family")
    return settled.select("key", F.col("up").alias("family")).unionByName(circles)


def pool_families(
    records: DataFrame, key: str = "key", same_as: str = "same_as", signal: str = "signal", none: str = "none",
    inherited_signal: str | None = None, inherited_none: str | None = None,
) -> DataFrame:
    """Every record with its family and the standing of all the family's evidence.

    A record whose ``same_as`` names one that is not there any more brings what it inherited
    from it (``inherited_*``, NULL counts as 0) into its family; where the other is there, its own evidence counts instead.
    """
    roots = family_roots(records, key, same_as)
    kept = lambda name: col(name) if name else F.lit(0)
    carried = records.select(
        col(key).alias("key"), col(same_as).alias("_same"), F.coalesce(col(signal), F.lit(0)).alias("_s"), F.coalesce(col(none), F.lit(0)).alias("_n"),
        F.coalesce(kept(inherited_signal), F.lit(0)).alias("_is"), F.coalesce(kept(inherited_none), F.lit(0)).alias("_in"))
    if inherited_signal or inherited_none:
        there = records.select(col(key).alias("_same")).distinct().withColumn("_there", F.lit(True))
        carried = carried.join(there, "_same", "left")
        gone = F.col("_same").isNotNull() & F.col("_there").isNull()
        carried = carried.withColumns({"_s": F.col("_s") + F.when(gone, F.col("_is")).otherwise(0), "_n": F.col("_n") + F.when(gone, F.col("_in")).otherwise(0)})
    counted = carried.select("key", "_s", "_n").join(roots, "key")
    totals = counted.groupBy("family").agg(
        F.coalesce(F.sum("_s"), F.lit(0)).alias("signal"), F.coalesce(F.sum("_n"), F.lit(0)).alias("none"),
        F.count(F.lit(1)).alias("members"),
    ).withColumns(standing(F.col("signal"), F.col("none")))
    return roots.join(totals, "family")


def repeated_reasons(ledger: DataFrame) -> DataFrame:
    """Patterns in failures: (pattern, subject, n), only those seen often enough.

    The same redundant column twice, three below base, two with almost no coverage.
    """
    reason = F.coalesce(F.col("reason"), F.lit(""))
    column = F.coalesce(
        F.nullif(F.regexp_extract(reason, SAME_COLUMN, 1), F.lit("")), F.nullif(F.regexp_extract(reason, SAME_COLUMN, 2), F.lit(""))
    )
    marks = F.array_compact(F.array(
        F.when(column.isNotNull(), F.struct(F.lit("redundant").alias("pattern"), column.alias("subject"), F.lit(2).alias("least"))),
        F.when(reason.contains("is not above"), F.struct(F.lit("below base").alias("pattern"), F.lit("").alias("subject"), F.lit(3).alias("least"))),
        F.when(F.col("coverage") < 0.05, F.struct(F.lit("sparse").alias("pattern"), F.lit("").alias("subject"), F.lit(2).alias("least"))),
    ))
    return (
        ledger.select(F.explode(marks).alias("_m")).select("_m.*")
        .groupBy("pattern", "subject", "least").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= F.col("least")).select("pattern", "subject", "n")
    )


def novelty_per_round(items: DataFrame, run: str = "run", round_col: str = "round", repeats: str = "repeats") -> DataFrame:
    """Proposed, new and repeated per (run, round), with the running number of new ones."""
    rounds = items.groupBy(col(run).alias("run"), col(round_col).alias("round")).agg(
        F.count(F.lit(1)).alias("proposed"), F.count_if(~col(repeats)).alias("new")
    )
    per_run = rounds.groupBy("run").agg(F.sum("new").alias("_new")).withColumn("_all", F.lit(1))
    # Runs named by text fall in buckets by their leading bytes.
    named = isinstance(per_run.schema["run"].dataType, T.StringType)
    lead = F.conv(F.rpad(F.hex(F.substring(F.col("run").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint") if named else None
    before = running_totals(per_run, ["_all"], "run", ["_new"], bucket=lead).select("run", "_new_before")
    along = Window.partitionBy("run").orderBy("round")
    return rounds.join(before, "run").select(
        "run", "round", "proposed", "new", (F.col("proposed") - F.col("new")).alias("repeated"),
        (F.col("_new_before") + F.sum("new").over(along)).alias("cumulative_new"),
    )
