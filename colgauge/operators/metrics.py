"""Ranking metrics over long predictions: one row per (variant, split, id) with y and score.

Every metric is computed for all variants and splits at once from one table of score
blocks. In :func:`adjusted_gini` rows of equal score share their positions; capture
and calibration split a block of equal scores by ``tie`` (a unique number per row),
or share it evenly when ``tie`` is None.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from colgauge.functions.scalars import col
from colgauge.operators.order import quantiles, running_totals
from colgauge.session import materialise

GROUP = ("variant", "split")
NOT_AN_OUTCOME = -9999
TIE_STEPS = 1024          # by which rows of equal score are counted before any are put in order
FLAG_SHARES = (0.01, 0.02, 0.05, 0.10, 0.20)


def score_cells(pred: DataFrame, group: Sequence[str] = GROUP, y: str = "y", score: str = "score") -> DataFrame:
    """Rows counted by group, score and outcome, written: (group, value, y, rows). Trees give few scores, so few cells."""
    rows = pred.select(*[col(g).alias(g) for g in group], col(score).cast("double").alias("value"), col(y).cast("double").alias("y"))
    return materialise(rows.groupBy(*group, "value", "y").agg(F.count(F.lit(1)).alias("rows")), "scores")


def score_blocks(
    pred: DataFrame, group: Sequence[str] = GROUP, y: str = "y", score: str = "score", cells: DataFrame | None = None
) -> DataFrame:
    """Rows summed per score, in falling score order.

    ``n`` and ``sy`` cover rows with an outcome; ``m``, ``my`` and ``mp`` leave out
    the not-an-outcome code as well; ``rows`` and ``sp`` cover every row. ``cells``, if given, are :func:`score_cells` of ``pred``.
    """
    cells = score_cells(pred, group, y, score) if cells is None else cells
    outcome, rows, zero = F.col("y"), F.col("rows"), F.lit(0.0)
    valid = outcome.isNotNull() & (outcome != NOT_AN_OUTCOME)
    counted = cells.select(
        *[col(g) for g in group], "value",
        F.when(outcome.isNotNull(), rows).otherwise(0).alias("n"), F.coalesce(outcome * rows, zero).alias("sy"),
        F.when(valid, rows).otherwise(0).alias("m"), F.when(valid, outcome * rows).otherwise(zero).alias("my"), "rows",
    )
    # A block's rows have one score: its sums follow from its counts.
    score_sum = lambda n: F.when(F.col(n) > 0, F.coalesce("value", zero) * F.col(n)).otherwise(zero)
    blocks = counted.withColumns({"mp": score_sum("m"), "sp": score_sum("rows")})
    return running_totals(blocks, group, "value", ["n", "sy", "m", "my", "mp", "rows", "sp"], descending=True, merge=True)


def _cumulated() -> Column:
    """The running total of y summed over rows; rows of equal value share positions."""
    n, s = F.col("n"), F.col("sy")
    return F.sum(n * F.col("sy_before") + s * (n + 1) / 2)


def _curve(cumulated: str, total: str, n: str) -> Column:
    """2 x area under the cumulative share of y, less 1."""
    curve = (2 * F.col(cumulated) / F.col(total) - 1) / F.col(n) - 1
    return F.when((F.col(n) > 0) & (F.col(total) != 0), curve)


def _perfect(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, _x2): the curve of the order by y itself, from :func:`score_cells`."""
    outcomes = cells.filter(F.col("y").isNotNull()).groupBy(*group, F.col("y").alias("value")).agg(
        F.sum("rows").alias("n"), F.sum(F.col("y") * F.col("rows")).alias("sy")
    )
    blocks = running_totals(outcomes, group, "value", ["n", "sy"], descending=True)
    out = blocks.groupBy(*group).agg(_cumulated().alias("_c"), F.max("sy_total").alias("_s"), F.max("n_total").alias("_n"))
    return out.select(*group, _curve("_c", "_s", "_n").alias("_x2"))


def _gini(curve: Column) -> Column:
    return F.when(F.col("_x2") != 0, curve / F.col("_x2")).alias("adj_gini")


def adjusted_gini(
    pred: DataFrame, group: Sequence[str] = GROUP, y: str = "y", score: str = "score"
) -> DataFrame:
    """The Gini of the score order over that of a perfect order: (group, adj_gini)."""
    cells = score_cells(pred, group, y, score)
    areas = score_blocks(pred, group, y, score, cells).groupBy(*group).agg(
        _cumulated().alias("_c"), F.max("sy_total").alias("_s"), F.max("n_total").alias("_n")
    )
    both = areas.join(_perfect(cells, group), list(group), "left")
    return both.select(*group, _gini(_curve("_c", "_s", "_n")))


def top_sums(
    pred: DataFrame,
    blocks: DataFrame,
    cuts: Mapping[str, tuple[str, str]],
    group: Sequence[str] = GROUP,
    y: str = "y",
    score: str = "score",
    tie: str | None = "id",
) -> DataFrame:
    """Sums over the first k rows in falling score order, for several k at once.

    ``cuts`` maps a name to the counter it counts in (``n`` or ``m``) and its k, an
    expression that may use ``n_total`` and ``m_total``. Gives ``{name}_y`` and ``{name}_p`` per group.
    Only the one block each cut falls inside is ever looked at row by row; where the
    cuts fall is written out first, one row per group, as the rows are read by it.
    """
    wanted = ", ".join(
        f"named_struct('cut', '{name}', 'counter', '{counter}', 'k', CAST({k} AS DOUBLE))" for name, (counter, k) in cuts.items()
    )
    pick = lambda n, m: f"IF(c.counter = 'n', {n}, {m})"
    need = f"(c.k - {pick('n_before', 'm_before')})"
    # Few blocks hold a cut: the plain comparison spares the others the lists. Each cut
    # lies in one block, so a group gathers at most one entry per cut.
    holds = " OR ".join(
        f"({counter}_before < {k} AND {k} <= {counter}_before + {counter})" for counter, k in cuts.values()
    )
    held = F.expr(
        f"CASE WHEN {holds} THEN transform(filter(array({wanted}), c -> {need} > 0 AND {need} <= {pick('n', 'm')}), c -> named_struct("
        f"'cut', c.cut, 'counter', c.counter, 'score', value, 'need', {need}, 'size', CAST({pick('n', 'm')} AS DOUBLE), "
        f"'before_y', {pick('sy_before', 'my_before')}, 'all_y', {pick('sy', 'my')}, "
        f"'before_p', {pick('sp_before', 'mp_before')}, 'all_p', {pick('sp', 'mp')})) END"
    )
    # Rows are summed here rather than read off the running totals: what one side of
    # the running totals leaves unused would keep both from sharing their shuffle.
    totals = [F.max(f"{c}_total").alias(f"{c}_total") for c in ("n", "m", "sy", "my", "mp", "sp")]
    totals += [F.sum("rows").alias("rows_total"), _cumulated().alias("cumulated")]
    out = blocks.withColumn("_held", held).groupBy(*group).agg(
        *totals, F.flatten(F.collect_list("_held")).alias("_cuts")
    )
    inside = "c.need / c.size * c.all_{0}" if tie is None else "IF(c.need < c.size, 0D, c.all_{0})"
    found = F.expr(
        "map_from_entries(transform(_cuts, c -> struct(c.cut, named_struct("
        f"'y', c.before_y + {inside.format('y')}, 'p', c.before_p + {inside.format('p')}))))"
    )
    value = lambda source, name, label: f"coalesce({source}['{name}'].{label}, 0D)"
    kept = [*group, *[f"{c}_total" for c in ("n", "m", "rows", "sy", "my", "mp", "sp")], "cumulated"]
    if tie is None:
        return out.withColumn("_found", found).select(
            *kept, *[F.expr(f"{value('_found', name, label)} AS {name}_{label}") for name in cuts for label in ("y", "p")]
        )
    out = materialise(out, "cuts")
    inner = [f"_{g}" for g in group]
    split = out.select(
        *[col(g).alias(f"_{g}") for g in group], F.expr("explode(filter(_cuts, c -> c.need < c.size)) AS _c")
    ).select(*inner, "_c.cut", "_c.counter", "_c.need", F.col("_c.score").alias("_score"))
    # Each cut has a number, so that rows carry that rather than the names of its group.
    split = materialise(split.withColumn("_cut", F.monotonically_increasing_id()), "split-blocks")
    outcome = col(y).cast("double")
    counted = F.when(F.col("counter") == "n", outcome.isNotNull()).otherwise(
        outcome.isNotNull() & (outcome != NOT_AN_OUTCOME)
    )
    same = [col(g) == col(f"_{g}") for g in group]
    rows = pred.join(split, [*same, col(score).cast("double").eqNullSafe(F.col("_score"))]).filter(counted)
    tied = rows.select("_cut", "need", _tie_order(pred, tie).alias("_tie"), outcome.alias("_y"), F.coalesce("_score", F.lit(0.0)).alias("_p"))
    sums = _first_by_tie(tied, pred.select(_tie_order(pred, tie).alias("_tie")), ["_cut"])
    sums = sums.join(split.select("_cut", *inner, "cut"), "_cut")
    extra = sums.groupBy(*inner).agg(
        F.map_from_entries(F.collect_list(F.struct("cut", F.struct("y", "p")))).alias("_extra")
    )
    joined = out.withColumn("_found", found).join(extra, same, "left")
    return joined.select(*kept, *[
        F.expr(f"{value('_found', name, label)} + {value('_extra', name, label)} AS {name}_{label}")
        for name in cuts for label in ("y", "p")
    ])


def _first_by_tie(tied: DataFrame, ties: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, y, p): sums of ``_y`` and ``_p`` over the ``need`` rows of a group that come first by ``_tie``.

    Rows are counted by equal steps of the range of ``ties`` where they lie. Only those of the one step that holds the last of
    the ``need`` rows are put in order.
    """
    number = F.col("_tie").cast("double")
    low, high = ties.agg(F.min(number), F.max(number)).first()
    width = (high - low) / TIE_STEPS if low is not None else 0.0
    step = F.floor((number - F.lit(low)) / F.lit(width)) if 0 < width < float("inf") else F.lit(0)
    placed = tied.withColumn("_step", F.coalesce(F.when(F.isnan(number), F.lit(TIE_STEPS + 1)).otherwise(step).cast("bigint"), F.lit(-1)))
    keys = [*group, "need"]
    counted = placed.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_y"), F.sum("_p").alias("_p"))
    before = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    counted = materialise(counted.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "tie-steps")
    whole = counted.filter(F.col("n_before") + F.col("n") <= F.col("need")).select(*group, "_y", "_p")
    split = counted.filter((F.col("n_before") < F.col("need")) & (F.col("n_before") + F.col("n") > F.col("need")))
    # One step for each group.
    split = F.broadcast(split.select(*group, "_step", (F.col("need") - F.col("n_before")).alias("_left")))
    inside = placed.join(split, [*group, "_step"]).groupBy(*group, "_left", "_tie").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_y"), F.sum("_p").alias("_p"))
    picked = running_totals(materialise(inside, "tied"), [*group, "_left"], "_tie", ["n", "_y", "_p"]).filter(F.col("n_before") < F.col("_left"))
    return whole.unionByName(picked.select(*group, "_y", "_p")).groupBy(*group).agg(F.sum("_y").alias("y"), F.sum("_p").alias("p"))


def _tie_order(pred: DataFrame, tie: str) -> Column:
    """Ids that are numbers order a tie themselves, all others by their hash."""
    number = isinstance(pred.select(col(tie).alias("t")).schema["t"].dataType, T.NumericType)
    return col(tie) if number else F.xxhash64(col(tie))


def _capture_cuts(shares: Sequence[float]) -> dict[str, tuple[str, str]]:
    return {f"c{i}": ("n", f"floor(n_total * {float(p)!r}D)") for i, p in enumerate(shares)}


def _capture_columns(shares: Sequence[float]) -> list[Column]:
    usable = (F.col("n_total") > 0) & (F.col("sy_total") != 0)
    return [
        F.when(usable, F.col(f"c{i}_y") / F.col("sy_total")).alias(f"capture_rate_{p:g}") for i, p in enumerate(shares)
    ]


def _calibration_cuts(bins: int) -> dict[str, tuple[str, str]]:
    return {f"g{i}": ("m", f"ceil({i} * m_total / {bins})") for i in range(1, bins)}


def _calibration_column(bins: int) -> Column:
    """Written as one SQL expression: ``bins`` groups would be hundreds of column calls."""
    edges = range(1, bins)
    y = f"array(0D, {', '.join([*[f'g{i}_y' for i in edges], 'my_total'])})"
    p = f"array(0D, {', '.join([*[f'g{i}_p' for i in edges], 'mp_total'])})"
    k = f"array(0L, {', '.join([*[f'ceil({i} * m_total / {bins})' for i in edges], 'm_total'])})"
    groups = (
        f"transform(sequence(1, {bins}), i -> named_struct('n', element_at({k}, i + 1) - element_at({k}, i), "
        f"'y', element_at({y}, i + 1) - element_at({y}, i), 'p', element_at({p}, i + 1) - element_at({p}, i)))"
    )
    means = f"transform(filter({groups}, g -> g.n > 0), g -> named_struct('y', g.y / g.n, 'p', g.p / g.n))"
    missed = f"aggregate({means}, 0D, (t, g) -> t + abs(g.p - g.y))"
    actual = f"aggregate({means}, 0D, (t, g) -> t + abs(g.y))"
    return F.expr(f"CASE WHEN m_total > 0 AND {actual} != 0 THEN 1 - {missed} / {actual} END AS accuracy")


def capture_rate(
    pred: DataFrame, shares: Sequence[float], group: Sequence[str] = GROUP, y: str = "y", score: str = "score",
    tie: str | None = "id",
) -> DataFrame:
    """The share of all y in the top shares of rows: capture_rate_{share} per group."""
    found = top_sums(pred, score_blocks(pred, group, y, score), _capture_cuts(shares), group, y, score, tie)
    return found.select(*group, *_capture_columns(shares))


def calibration_accuracy(
    pred: DataFrame, bins: int = 10, group: Sequence[str] = GROUP, y: str = "y", score: str = "score",
    tie: str | None = "id",
) -> DataFrame:
    """1 - total gap between mean score and mean outcome over equal score groups, per actual."""
    found = top_sums(pred, score_blocks(pred, group, y, score), _calibration_cuts(bins), group, y, score, tie)
    return found.select(*group, _calibration_column(bins))


def evaluate_predictions(
    pred: DataFrame, shares: Sequence[float] = (0.01, 0.05, 0.10), bins: int = 10,
    group: Sequence[str] = GROUP, y: str = "y", score: str = "score", tie: str | None = "id",
) -> DataFrame:
    """The full metric bundle of every variant and split, one row each."""
    cells = score_cells(pred, group, y, score)
    blocks = score_blocks(pred, group, y, score, cells)
    cuts = {**_capture_cuts(shares), **_calibration_cuts(bins)}
    found = top_sums(pred, blocks, cuts, group, y, score, tie)
    return found.join(_perfect(cells, group), list(group), "left").select(
        *group, F.col("rows_total").alias("n_rows"),
        _gini(_curve("cumulated", "sy_total", "n_total")), _calibration_column(bins),
        F.try_divide(F.col("sy_total"), F.col("n_total")).alias("actual_mean"),
        F.try_divide(F.col("sp_total"), F.col("rows_total")).alias("pred_mean"), *_capture_columns(shares),
    )


def gini_gain(challenger: str | Column, champion: str | Column) -> tuple[Column, Column]:
    """Absolute and relative lift; NULL where either is, and relative to 0 too."""
    gain = col(challenger) - col(champion)
    return gain, F.when(col(champion) != 0, gain / F.abs(col(champion)))


def wide_comparison(
    metrics: DataFrame, splits: Sequence[str] = ("train", "valid", "test"), baseline: str = "base",
    shares: Sequence[float] = (0.05,), accuracy: bool = False,
) -> DataFrame:
    """One row per variant: Gini and capture per split, with gains over the baseline."""
    captures = {f"top{p * 100:g}": f"capture_rate_{p:g}" for p in shares}
    champion = metrics.filter(F.col("variant") == baseline).select(
        "split", F.col("adj_gini").alias("_gini"), *[F.col(f"`{c}`").alias(f"_{n}") for n, c in captures.items()]
    )
    gain, gain_pct = gini_gain("adj_gini", "_gini")
    compared = metrics.join(champion, "split", "left").withColumns({
        "_gain": gain, "_gain_pct": gain_pct,
        **{f"_gain_{n}": F.col(f"`{c}`") - F.col(f"_{n}") for n, c in captures.items()},
    })
    columns = []
    for s in splits:
        here = lambda c, s=s: F.max(F.when(F.col("split") == s, c))
        columns.append(here(F.col("adj_gini")).alias(f"adj_gini_{s}"))
        if accuracy:
            columns.append(here(F.col("accuracy")).alias(f"accuracy_{s}"))
        columns += [here(F.col(f"`{c}`")).alias(f"capture_{n}_{s}") for n, c in captures.items()]
        columns += [here(F.col("_gain")).alias(f"gini_gain_{s}"), here(F.col("_gain_pct")).alias(f"gini_gain_pct_{s}")]
        columns += [here(F.col(f"_gain_{n}")).alias(f"capture_gain_{n}_{s}") for n in captures]
    return compared.groupBy("variant").agg(*columns)


def score_cutoffs(
    pred: DataFrame, shares: Sequence[float] = FLAG_SHARES, score: str = "score", split: str = "test"
) -> DataFrame:
    """The score that a share of the split lies above: (variant, share, cutoff)."""
    found = quantiles(pred.filter(F.col("split") == split), [score], [1 - s for s in shares], by=["variant"])
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(s)).alias("share"), F.col("values")[i].alias("cutoff")) for i, s in enumerate(shares)
    ]))
    return found.select("variant", rows.alias("_r")).select("variant", "_r.*")


def score_level(pred: DataFrame, baseline: str = "base", split: str = "test", score: str = "score") -> DataFrame:
    """Mean score per variant and its relative change from the baseline's."""
    means = pred.filter(F.col("split") == split).groupBy("split", "variant").agg(F.avg(score).alias("score_mean"))
    base = means.filter(F.col("variant") == baseline).select("split", F.col("score_mean").alias("score_base"))
    change = F.when(F.col("score_base") != 0, F.col("score_mean") / F.col("score_base") - 1)
    return means.join(base, "split", "left").select("variant", "score_mean", "score_base", change.alias("score_change"))


def new_feature_share(attribution: DataFrame, new: Sequence[str]) -> DataFrame:
    """The share of each variant's mean attribution that lands on new features."""
    value = F.col("mean_abs_attr")
    out = attribution.groupBy("variant").agg(
        F.sum(value).alias("_all"), F.coalesce(F.sum(F.when(F.col("feature").isin(*new), value)), F.lit(0.0)).alias("_new")
    )
    return out.filter(F.col("_all") > 0).select("variant", (F.col("_new") / F.col("_all")).alias("new_share"))
