"""The four gates a candidate has to clear, and the call on the batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

PASS, FAIL = "PASS", "FAIL"
NOT_REACHED, NOT_EVALUABLE = "not reached", "not evaluable"
GATES = ("data quality", "feature selection", "gini gain", "attribution rank")


@dataclass(frozen=True)
class VerdictOptions:
    gini_split: str = "test"
    min_gini_gain: float = 0.005
    require_valid_too: bool = False
    max_rank_pct: float = 0.5
    attribution_variant: str = "base_plus_new"  # or leave_one_in: each candidate's own model
    enforce: bool = False


def attribution_ranks(attribution: DataFrame) -> DataFrame:
    """Adds attr_rank 1..n and rank_pct = rank / n per variant."""
    by = Window.partitionBy("variant")
    ranked = attribution.withColumn("attr_rank", F.row_number().over(by.orderBy(F.desc("mean_abs_attr"), "feature")))
    return ranked.withColumn("n_ranked", F.count(F.lit(1)).over(by)).withColumn("rank_pct", F.col("attr_rank") / F.col("n_ranked"))


def candidate_evidence(
    candidates: list[str],
    quality: DataFrame | None,
    selected: DataFrame | None,
    comparison: DataFrame | None,
    attribution: DataFrame | None,
    options: VerdictOptions = VerdictOptions(),
) -> DataFrame:
    """One row per candidate with what every gate needs; what a run did not produce is NULL.

    (feature, quality_passed, kept, decided_by, reason, gain, gain_valid, attr_rank, n_ranked)
    """
    some = next(t for t in (quality, selected, comparison, attribution) if t is not None)
    rows = some.sparkSession.createDataFrame([(c,) for c in candidates], "feature string")
    text, num = F.lit(None).cast("string"), F.lit(None).cast("double")
    if quality is not None:
        rows = rows.join(quality.select("feature", F.col("passed").alias("quality_passed")), "feature", "left").withColumn(
            "quality_passed", F.coalesce("quality_passed", F.lit(True)))
    else:
        rows = rows.withColumn("quality_passed", F.lit(None).cast("boolean"))
    if selected is not None:
        rows = rows.join(selected.select("feature", "kept", "decided_by", "reason"), "feature", "left").withColumn(
            "kept", F.coalesce("kept", F.lit(False)))
    else:
        rows = rows.withColumns({"kept": F.lit(True), "decided_by": text, "reason": text})
    if comparison is not None:
        gains = comparison.filter(F.col("variant").startswith("loi__")).select(
            F.regexp_replace("variant", "^loi__", "").alias("feature"), F.col(f"gini_gain_{options.gini_split}").alias("gain"),
            (F.col("gini_gain_valid") if "gini_gain_valid" in comparison.columns else num).alias("gain_valid"))
        rows = rows.join(gains, "feature", "left")
    else:
        rows = rows.withColumns({"gain": num, "gain_valid": num})
    if attribution is not None:
        ranked = attribution_ranks(attribution).select("variant", "feature", "attr_rank", "n_ranked")
        if options.attribution_variant == "leave_one_in":
            ranked = ranked.filter(F.col("variant") == F.concat(F.lit("loi__"), F.col("feature")))
        else:
            ranked = ranked.filter(F.col("variant") == options.attribution_variant)
        rows = rows.join(ranked.drop("variant"), "feature", "left")
    else:
        rows = rows.withColumns({"attr_rank": F.lit(None).cast("int"), "n_ranked": F.lit(None).cast("bigint")})
    return rows


def _signed(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%+.4f", value))


def candidate_verdicts(evidence: DataFrame, options: VerdictOptions = VerdictOptions()) -> DataFrame:
    """Every gate's outcome per candidate, as one cascade.

    With ``enforce`` the first failed gate ends it and later ones are not reached;
    otherwise all four are measured. A gate without evidence never fails anyone.
    """
    e, gain = evidence, F.col("gain")
    pct = F.col("attr_rank") / F.col("n_ranked")
    enough = gain >= options.min_gini_gain
    if options.require_valid_too:
        enough = enough & (F.col("gain_valid").isNull() | (F.col("gain_valid") >= options.min_gini_gain))
    judged = {
        GATES[0]: F.when(F.col("quality_passed").isNull(), NOT_EVALUABLE).when(F.col("quality_passed"), PASS).otherwise(FAIL),
        GATES[1]: F.when(F.col("kept"), PASS).otherwise(FAIL),
        GATES[2]: F.when(gain.isNull(), NOT_EVALUABLE).when(enough, PASS).otherwise(FAIL),
        GATES[3]: F.when(F.col("attr_rank").isNull(), NOT_EVALUABLE).when(pct <= options.max_rank_pct, PASS).otherwise(FAIL),
    }
    whys = {
        GATES[0]: F.lit("failed data quality checks"),
        GATES[1]: F.when(F.col("decided_by").isNull(), "not carried forward").otherwise(
            F.concat_ws(": ", F.col("decided_by"), F.col("reason"))),
        GATES[2]: F.concat(F.lit("gini gain "), _signed(gain), F.lit(f" on {options.gini_split}, below {options.min_gini_gain:+.4f}")),
        GATES[3]: F.concat(
            F.lit("attribution rank "), F.col("attr_rank").cast("string"), F.lit(" of "), F.col("n_ranked").cast("string"),
            F.lit(f", outside the top {options.max_rank_pct:.0%}")),
    }
    states, stopped, first, reasons = {}, F.lit(False), None, []
    for gate, state in judged.items():
        shown = F.when(stopped, NOT_REACHED).otherwise(state) if options.enforce else state
        failed = shown == FAIL
        states[gate] = shown
        reasons.append(F.when(failed, whys[gate]))
        first = F.when(failed, gate) if first is None else first.when(failed, gate)
        stopped = stopped | failed
    n_failed = sum(((s == FAIL).cast("int") for s in states.values()), F.lit(0))
    return e.select(
        "feature", F.when(stopped, FAIL).otherwise(PASS).alias("verdict"), first.otherwise("").alias("failed_at"),
        *[s.alias(g.replace(" ", "_")) for g, s in states.items()], n_failed.alias("n_gates_failed"),
        F.concat_ws(" | ", *reasons).alias("reason"), gain.alias(f"gini_gain_{options.gini_split}"), pct.alias("rank_pct"),
    )


def failed_at_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("verdict") == FAIL).groupBy("failed_at").agg(F.count(F.lit(1)).alias("n"))


def decide_batch(verdicts: DataFrame, comparison: DataFrame | None = None, options: VerdictOptions = VerdictOptions()) -> DataFrame:
    """One row: KEEP when any candidate passed, else TRY A NEW BATCH, with the worst gate named."""
    passed = F.col("verdict") == PASS
    per_gate = [F.count_if(~passed & (F.col("failed_at") == g)) for g in GATES]
    worst = F.array_max(F.array(*[
        F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(g).alias("gate")) for i, (g, n) in enumerate(zip(GATES, per_gate))
    ]))
    out = verdicts.agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(passed).alias("n_passed"),
        F.array_sort(F.collect_list(F.when(passed, F.col("feature")))).alias("passed"), worst.alias("_worst"),
    )
    gain = F.lit(None).cast("double")
    if comparison is not None:
        gain = comparison.filter(F.col("variant") == "base_plus_new").agg(F.max(f"gini_gain_{options.gini_split}")).scalar()
    kept = F.col("n_passed") > 0
    none = F.concat(F.lit("every candidate was stopped, most often at: "), F.when(F.col("_worst.n") > 0, F.col("_worst.gate")).otherwise("unknown"))
    note = F.when(F.col("n_candidates") == 0, "there was nothing to judge").when(
        kept, F.concat(F.col("n_passed").cast("string"), F.lit(" candidates cleared every gate"))).otherwise(none)
    return out.select(
        F.when(kept, "KEEP").otherwise("TRY A NEW BATCH").alias("verdict"), "n_candidates", "n_passed", "passed",
        gain.alias("batch_gini_gain"), F.when(~kept & (F.col("_worst.n") > 0), F.col("_worst.gate")).otherwise("").alias("worst_gate"), note.alias("note"),
    )


def screen_gate(gain: Column, capture_gain: Column, min_gini_gain: float, min_capture_gain: float | None = None) -> Column:
    """Why a screened feature misses the gate; empty when it clears it. Both gains must be strictly above."""
    short = F.concat(F.lit("Gini gain "), _signed(gain), F.lit(f" is not above {min_gini_gain:+.4f}"))
    out = F.when(gain.isNull() | (gain <= min_gini_gain), short)
    if min_capture_gain is not None:
        also = F.concat(F.lit("capture-rate gain "), _signed(capture_gain), F.lit(f" is not above {min_capture_gain:+.4f}"))
        out = out.when(capture_gain.isNull() | (capture_gain <= min_capture_gain), also)
    return out.otherwise("")
