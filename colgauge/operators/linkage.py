"""Joins of event histories to model rows, point in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colgauge.functions.scalars import col, seconds
from colgauge.operators.order import positions, running_totals, time_bucket
from colgauge.session import materialise

STRICT, INCLUSIVE = "strict", "inclusive"


AMOUNT = "decimal(28,9)"
SLICE = 50_000      # events of one key that meet its ids in one task, where a link is told to spread


def _aslist(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def before_as_of(time: str | Column, as_of: str | Column, rule: str = STRICT) -> Column:
    """The point-in-time predicate: strictly before, or up to and including."""
    if rule not in (STRICT, INCLUSIVE):
        raise ValueError(f"rule must be {STRICT!r} or {INCLUSIVE!r}, got {rule!r}")
    return col(time) < col(as_of) if rule == STRICT else col(time) <= col(as_of)


def days_before(as_of: str | Column, days: int) -> Column:
    return col(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def link_point_in_time(
    ids: DataFrame,
    source: DataFrame,
    *,
    key: str | Sequence[str],
    time: str,
    id_col: str = "id",
    as_of: str = "as_of",
    rule: str = STRICT,
    days: int | None = None,
    bound_scan: bool = True,
    slice_rows: int | None = None,
) -> DataFrame:
    """Every event of an id's key before its as-of date: (id, as_of, source columns).

    Many-to-many by design. With ``days`` the join key also holds the time interval,
    so a busy key is spread over its intervals and only neighbouring ones meet; the
    exact window is then applied. ``bound_scan`` gives the source scan the range of
    as-of dates as a filter it can push down. ``slice_rows`` is for links without ``days``: keys are
    counted, the events of one with more than that many are dealt over slices in time, and
    its ids are repeated for each slice.
    """
    keys = _aslist(key)
    base = ids.select(col(id_col), col(as_of), *[col(k) for k in keys])
    events = source.filter(col(time).isNotNull())
    if bound_scan:
        latest = ids.agg(F.max(col(as_of))).scalar()
        events = events.filter(col(time) < latest if rule == STRICT else col(time) <= latest)
        if days is not None:
            # The minimum of a one-field struct is aggregated another way than the maximum
            # above; alike, both would be merged into one value the scan cannot use.
            first_day = F.min(F.struct(col(as_of).alias("at")))["at"]
            events = events.filter(col(time) >= ids.filter(col(as_of).isNotNull()).agg(days_before(first_day, days)).scalar())
    on = list(keys)
    if days is not None:
        width = int(days) * 86_400
        first = F.floor(seconds(days_before(as_of, days)) / F.lit(width))
        last = F.floor(seconds(as_of) / F.lit(width))
        base = base.withColumn("_interval", F.explode(F.sequence(first, last)))
        events = events.withColumn("_interval", time_bucket(time, width))
        on.append("_interval")
    elif slice_rows:
        base, events = _sliced(base, events, keys, time, slice_rows)
        on.append("_slice")
    linked = base.join(events, on, "inner").filter(before_as_of(time, as_of, rule))
    if days is not None:
        linked = cut_window(linked, time, as_of, days)
    others = [c for c in source.columns if c not in (id_col, as_of)]
    return linked.select(id_col, as_of, *others)


def cut_window(linked: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Events of the last ``days`` days, the far end included."""
    return linked.filter(col(time) >= days_before(as_of, days))


def check_linkage(linked: DataFrame, ids: DataFrame, *, time: str, id_col: str = "id",
                  as_of: str = "as_of", rule: str = STRICT) -> DataFrame:
    """One row on a link: rows, match rate, late rows, unreadable times, unknown ids."""
    per_id = linked.groupBy(col(id_col)).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(~before_as_of(time, as_of, rule)).alias("_late"),
        F.count_if(col(time).isNull()).alias("_unparsed"),
    )
    known = ids.select(col(id_col)).distinct().withColumn("_known", F.lit(1))
    joined = known.join(per_id, id_col, "full_outer")
    zero = F.lit(0)
    return joined.agg(
        F.coalesce(F.sum("_rows"), zero).alias("n_rows"),
        F.count_if(F.col("_known").isNotNull()).alias("n_ids"),
        F.count_if(F.col("_known").isNotNull() & F.col("_rows").isNotNull()).alias("matched_ids"),
        F.coalesce(F.sum("_late"), zero).alias("late_rows"),
        F.coalesce(F.sum("_unparsed"), zero).alias("unparsed_rows"),
        F.count_if(F.col("_known").isNull()).alias("unknown_ids"),
    ).withColumn("match_rate", F.try_divide(F.col("matched_ids"), F.col("n_ids")))


def linkage_scale(linked: DataFrame, n_ids: int | Column, n_full: int | Column, id_col: str = "id") -> DataFrame:
    """Events per linked id, and the rows the link would give on the full table."""
    per_id = linked.groupBy(col(id_col)).agg(F.count(F.lit(1)).alias("_n"))
    size = n_ids if isinstance(n_ids, Column) else F.lit(n_ids)
    full = n_full if isinstance(n_full, Column) else F.lit(n_full)
    return per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("matched_ids"),
        F.max("_n").alias("max_per_id"),
    ).select(
        "n_rows", "matched_ids", "max_per_id",
        F.try_divide(F.col("n_rows"), F.col("matched_ids")).alias("events_per_id"),
        F.round(F.try_divide(F.col("n_rows") * full, size)).cast("bigint").alias("projected_rows"),
    )


def size_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """The rows a join will give, from the rows per key, without joining the rows.

    For left, right and full joins the preserved side is added whole, so the number
    is an upper bound. ``largest_key`` is what the busiest key alone produces.
    """
    keys = _aslist(keys)
    lc = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    rc = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    l, r = F.col("_l"), F.col("_r")
    sized = lc.join(rc, keys, "full_outer").agg(
        F.coalesce(F.sum(l * r), F.lit(0)).alias("matched_rows"),
        F.coalesce(F.sum(l), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum(r), F.lit(0)).alias("right_rows"),
        F.coalesce(F.max(l * r), F.lit(0)).alias("largest_key"),
        F.coalesce(F.max(F.when(r.isNotNull(), l)), F.lit(0)).alias("right_per_key"),
        F.coalesce(F.max(F.when(l.isNotNull(), r)), F.lit(0)).alias("left_per_key"),
    )
    keep_left = F.col("left_rows") if how in ("left", "outer", "full") else F.lit(0)
    keep_right = F.col("right_rows") if how in ("right", "outer", "full") else F.lit(0)
    return sized.select(
        (F.col("matched_rows") + keep_left + keep_right).alias("n_rows"),
        ((F.col("left_per_key") > 1) & (F.col("right_per_key") > 1)).cast("int").alias("many_to_many"),
        "left_per_key", "right_per_key", "largest_key", "left_rows", "right_rows",
    )


def guard_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """The join, refused when keys repeat on both sides and it outgrows both."""
    size = size_join(left, right, keys, how).first()
    if size.many_to_many and size.n_rows > max(size.left_rows, size.right_rows):
        raise ValueError(
            f"many-to-many join: {size.left_rows:,} x {size.right_rows:,} rows give {size.n_rows:,}; "
            "bring one side to one row per key first"
        )
    return left.join(right, _aslist(keys), how)


def link_aggregate(ids: DataFrame, aggregate: DataFrame, *, key: str | Sequence[str], id_col: str = "id", as_of: str = "as_of",
                   period_end: str = "period_end", days: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """Period buckets of an id's key that ended before its as-of date; ``days`` and ``slice_rows`` as in :func:`link_point_in_time`.

    The aggregate is no scan that a bound could reach: give it raw events from :func:`bounded_source`.
    """
    return link_point_in_time(
        ids, aggregate, key=key, time=period_end, id_col=id_col, as_of=as_of, days=days, bound_scan=False, slice_rows=slice_rows)


def attach_feature(rows: DataFrame, feature: DataFrame, id_col: str = "id") -> DataFrame:
    """A feature joined back to every row, repeats of an id included.

    Of several rows of an id the largest is taken, compared column by column from the left, so no
    row is multiplied and the values of two rows are never mixed.
    """
    values = [c for c in feature.columns if c != id_col]
    single = feature.groupBy(id_col).agg(F.max(F.struct(*[col(c) for c in values])).alias("_largest"))
    return rows.join(single.select(id_col, *[F.col(f"_largest.`{c}`").alias(c) for c in values]), id_col, "left")


def backfill_columns(sample: DataFrame, pool: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Columns the sample lacks, joined from the pool by id.

    The plan fails while it runs on an id the pool does not hold or holds twice.
    """
    lacking = [c for c in columns if c not in sample.columns]
    if not lacking:
        return sample
    unknown = [c for c in lacking if c not in pool.columns]
    if unknown:
        raise KeyError(f"the pool does not have {unknown}")
    per_id = pool.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_copies"), F.max(F.struct(*[col(c) for c in lacking])).alias("_values")
    )
    joined = sample.join(per_id, id_col, "left")
    ok = (
        F.when(F.col("_copies").isNull(), F.raise_error(F.concat(F.lit("id not in the pool: "), col(id_col).cast("string"))))
        .when(F.col("_copies") > 1, F.raise_error(F.concat(F.lit("id repeats in the pool: "), col(id_col).cast("string"))))
        .otherwise(F.lit(True))
    )
    return joined.filter(ok.cast("boolean")).select(*sample.columns, *[F.col(f"_values.`{c}`").alias(c) for c in lacking])


def join_periods(a: DataFrame, b: DataFrame, id_col: str = "id", period_end: str = "period_end") -> DataFrame:
    """Two aggregates at each id's latest period that both have."""
    both = a.join(b, [id_col, period_end], "inner")
    payload = [c for c in both.columns if c not in (id_col, period_end)]
    latest = both.groupBy(id_col).agg(F.max(F.struct(period_end, *payload)).alias("_latest"))
    return latest.select(id_col, *[F.col(f"_latest.`{c}`").alias(c) for c in (period_end, *payload)])


def _sliced(base: DataFrame, events: DataFrame, keys: Sequence[str], time: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_slice``: steps of equal time between a busy key's first and last event, as many as its events need."""
    at = seconds(time).cast("double")
    counted = events.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_held"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    # At most one key for every ``rows`` events.
    busy = counted.filter(F.col("_held") > rows).withColumn("_slices", F.ceil(F.col("_held") / F.lit(rows)).cast("int")).drop("_held")
    last = F.coalesce(F.col("_slices") - 1, F.lit(0))
    share = F.try_divide(at - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    step = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("_slices")).cast("int"), last)
    dealt = events.join(busy, list(keys), "left").withColumn("_slice", F.coalesce(step, F.lit(0))).drop("_lo", "_hi", "_slices")
    repeated = base.join(busy.select(*keys, "_slices"), list(keys), "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), last))).drop("_slices")
    return repeated, dealt


def bounded_source(source: DataFrame, ids: DataFrame, time: str, as_of: str = "as_of", days: int | None = None) -> DataFrame:
    """The raw events that any as-of date can look back on, as a filter the scan can take.

    For sources that are summed to periods before they are linked: a period that ended before an as-of
    date holds only events before it. With ``days``, events older than the earliest look-back go as well.
    """
    kept = source.filter(col(time) < ids.agg(F.max(col(as_of))).scalar())
    if days is not None:
        first = F.min(F.struct(col(as_of).alias("at")))["at"]
        kept = kept.filter(col(time) >= ids.filter(col(as_of).isNotNull()).agg(days_before(first, days)).scalar())
    return kept


def last_event_before(
    ids: DataFrame,
    source: DataFrame,
    *,
    key: str,
    time: str,
    tie: str,
    payload: Sequence[str],
    id_col: str = "id",
    as_of: str = "as_of",
    rule: str = STRICT,
) -> DataFrame:
    """Each id's latest event before its as-of date: an as-of join without pairs.

    Events and as-of dates of a key are put in one time order as one block per
    instant, and each as-of date looks up the latest event that comes before it.
    Ties of an instant go to the largest ``tie``.
    """
    wanted = [time, tie, *[c for c in payload if c not in (time, tie)]]
    events = source.filter(col(time).isNotNull() & col(key).isNotNull()).select(
        col(key).alias("_key"), col(time).alias("_t"), F.struct(*[col(c) for c in wanted]).alias("_event")
    )
    points = ids.filter(col(key).isNotNull()).select(col(key).alias("_key"), col(as_of).alias("_t"))
    empty = F.lit(None).cast(events.schema["_event"].dataType)
    blocks = (
        events.unionByName(points.withColumn("_event", empty))
        .groupBy("_key", "_t")
        .agg(F.max("_event").alias("_event"))
    )
    found = _running_latest(blocks)
    seen = F.coalesce("_event", "_earlier") if rule == INCLUSIVE else F.col("_earlier")
    found = found.select("_key", "_t", seen.alias("_found"))
    joined = ids.join(found, (col(key) == F.col("_key")) & (col(as_of) == F.col("_t")), "left")
    return joined.select(
        id_col, as_of, *[F.col(f"_found.`{c}`").alias(c) for c in wanted]
    )


def _running_latest(blocks: DataFrame) -> DataFrame:
    """Adds ``_earlier``: the latest event of the key's earlier blocks."""
    from pyspark.sql import Window

    from colgauge.operators.order import carry_in

    b = blocks.withColumn("_bucket", time_bucket("_t", 30 * 86_400))
    b = carry_in(b, ["_key"], "_bucket", maxima={"_e": F.col("_event")})
    inside = Window.partitionBy("_key", "_bucket").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("_earlier", F.coalesce(F.max("_event").over(inside), F.col("_e_carry")))


def nth_last_event(linked: DataFrame, n: int, *, time: str, tie: str, id_col: str = "id") -> DataFrame:
    """The n-th latest of each id's linked events; ids with fewer have no row."""
    from pyspark.sql import Window

    latest = Window.partitionBy(id_col).orderBy(col(time).desc(), col(tie).desc())
    return linked.withColumn("_nth", F.row_number().over(latest)).filter((F.col("_nth") <= n) & (F.col("_nth") == n)).drop("_nth")


def nth_event_before(
    ids: DataFrame,
    source: DataFrame,
    n: int,
    *,
    key: str,
    time: str,
    tie: str,
    payload: Sequence[str],
    id_col: str = "id",
    as_of: str = "as_of",
    rule: str = STRICT,
) -> DataFrame:
    """The n-th latest event of each id's key before its as-of date: (id, as_of, time, tie, payload).

    Ids with fewer events have no row. No id is paired with its past: every event has its place
    along its key, an as-of date has the number of events before it, and the one it asks for is
    looked up by key and place. Places and numbers are running totals over time buckets, so
    neither a busy key nor a long history is ever in one task. Events of an instant are ordered by ``tie``.
    """
    wanted = [time, tie, *[c for c in payload if c not in (time, tie)]]
    events = source.filter(col(time).isNotNull() & col(key).isNotNull()).select(
        col(key).alias("_key"), col(time).alias("_t"), col(tie).alias("_tie"), F.struct(*[col(c) for c in wanted]).alias("_event"))
    placed = positions(events, ["_key"], [F.asc("_t"), F.asc("_tie")], time_bucket("_t", 30 * 86_400), "_place")
    points = ids.filter(col(key).isNotNull() & col(as_of).isNotNull()).select(
        col(id_col), col(as_of).alias("_as_of"), col(key).alias("_key"), col(as_of).alias("_t"))
    marks = points.select("_key", "_t", F.lit(0).alias("_n"))
    blocks = events.select("_key", "_t", F.lit(1).alias("_n")).union(marks).groupBy("_key", "_t").agg(F.sum("_n").alias("_n"))
    running = running_totals(blocks, ["_key"], "_t", ["_n"], bucket=time_bucket("_t", 30 * 86_400))
    before = F.col("_n_before") + (F.col("_n") if rule == INCLUSIVE else F.lit(0))
    asked = points.join(running.select("_key", "_t", (before - n + 1).alias("_place")), ["_key", "_t"]).filter("_place > 0")
    found = asked.join(placed.select("_key", "_place", "_event"), ["_key", "_place"])
    return found.select(id_col, F.col("_as_of").alias(as_of), *[F.col(f"_event.`{c}`").alias(c) for c in wanted])


def rolling_totals(
    events: DataFrame, *, key: str, time: str, measure: str, days: int, id_col: str, n: str = "n_events", total: str | None = None
) -> DataFrame:
    """For each event how many of its key lie in the ``days`` up to and including it, and their sum: (id, n, total).

    Events of the same instant count, as does one exactly ``days`` earlier. A total is the running
    total at the event less the one where its window opens, over a key cut into time buckets, so no event is paired
    with another and no key is one task. Sums as in :func:`window_totals`; an event without key or time has NULLs.
    """
    total = total or f"{measure}_sum"
    rows = events.select(
        col(id_col).alias("_id"), col(key).alias("_key"), col(time).cast("timestamp").alias("_t"),
        F.coalesce(col(measure).cast("double").try_cast(AMOUNT), F.lit(0).cast(AMOUNT)).alias("_s"))
    placed = rows.filter(F.col("_key").isNotNull() & F.col("_t").isNotNull())
    opens = F.col("_t") - F.expr(f"INTERVAL {int(days)} DAYS")
    marks = placed.select("_key", opens.alias("_t"), F.lit(0).alias("_n"), F.lit(0).cast(AMOUNT).alias("_s"))
    blocks = placed.select("_key", "_t", F.lit(1).alias("_n"), "_s").union(marks).groupBy("_key", "_t").agg(
        F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    running = running_totals(blocks, ["_key"], "_t", ["_n", "_s"], bucket=time_bucket("_t", 30 * 86_400))
    # An instant and the opening of its window are two blocks of the same table.
    start = running.select("_key", F.col("_t").alias("_opens"), F.col("_n_before").alias("_n0"), F.col("_s_before").alias("_s0"))
    ends = running.filter("_n > 0").withColumn("_opens", opens).join(start, ["_key", "_opens"]).select(
        "_key", "_t", (F.col("_n_before") + F.col("_n") - F.col("_n0")).cast("bigint").alias(n),
        (F.col("_s_before") + F.col("_s") - F.col("_s0")).cast("double").alias(total))
    found = placed.select("_id", "_key", "_t").join(ends, ["_key", "_t"]).select(F.col("_id").alias(id_col), n, total)
    absent = rows.filter(F.col("_key").isNull() | F.col("_t").isNull())
    return found.unionByName(absent.select(F.col("_id").alias(id_col)), allowMissingColumns=True)


def window_totals(
    ids: DataFrame,
    source: DataFrame,
    *,
    key: str,
    time: str,
    measure: str,
    windows: Sequence[int],
    id_col: str = "id",
    as_of: str = "as_of",
) -> DataFrame:
    """Events and their sum in several look-back windows per id, in one pass.

    A window total is the running total at the as-of date less the running total
    where the window opens, so no (id, event) pair is ever made: the work grows with
    ids plus events, whatever their key. Sums are kept to nine decimals, so nothing of
    a key's past cancels. A measure that is not finite, or 1e19 or more, counts as
    missing. Ids without a key or an as-of date have no events.
    """
    edges = {"e0": col(as_of), **{f"e{w}": days_before(as_of, w) for w in windows}}
    points = ids.filter(col(key).isNotNull() & col(as_of).isNotNull()).select(
        col(id_col), col(key).alias("_key"), F.explode(F.array(*[
            F.struct(F.lit(name).alias("edge"), at.cast("timestamp").alias("t")) for name, at in edges.items()
        ])).alias("_p")
    ).select(id_col, "_key", "_p.edge", F.col("_p.t").alias("_t"))
    events = source.filter(col(key).isNotNull() & col(time).isNotNull()).select(
        col(key).alias("_key"), col(time).cast("timestamp").alias("_t"),
        F.lit(1).alias("_n"), F.coalesce(col(measure).cast("double").try_cast(AMOUNT), F.lit(0).cast(AMOUNT)).alias("_s"),
    )
    marks = points.select("_key", "_t", F.lit(0).alias("_n"), F.lit(0).cast(AMOUNT).alias("_s"))
    blocks = events.unionByName(marks).groupBy("_key", "_t").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    running = running_totals(blocks, ["_key"], "_t", ["_n", "_s"], bucket=time_bucket("_t", 30 * 86_400))
    at_edge = points.join(running.select("_key", "_t", "_n_before", "_s_before"), ["_key", "_t"])
    wide = at_edge.groupBy(id_col).agg(*[
        F.max(F.when(F.col("edge") == name, F.col(f"_{m}_before"))).alias(f"_{m}_{name}")
        for name in edges for m in ("n", "s")
    ])
    labels = [(w, m, label, kind) for w in windows for m, label, kind in (("n", "n_events", "bigint"), ("s", f"{measure}_sum", "double"))]
    found = wide.select(id_col, *[
        (F.col(f"_{m}_e0") - F.col(f"_{m}_e{w}")).cast(kind).alias(f"{label}_{w}d") for w, m, label, kind in labels])
    without = ids.filter(col(key).isNull() | col(as_of).isNull()).select(
        col(id_col), *[F.lit(0).cast(kind).alias(f"{label}_{w}d") for w, _, label, kind in labels])
    return found.unionByName(without)


def merge_rankings(attribution: DataFrame, importance: DataFrame) -> DataFrame:
    """Both rankings side by side per (variant, feature), the strongest first."""
    return attribution.join(importance, ["variant", "feature"], "full_outer").orderBy(
        F.asc("variant"), F.desc_nulls_last("mean_abs_attr")
    )


def disjoint_splits(df: DataFrame, id_cols: str | Sequence[str], split: str = "split") -> DataFrame:
    """Ids found in two splits: one row per pair of splits, with their number and one example."""
    ids = _aslist(id_cols)
    # Few ids, if any, have two splits: only theirs are listed.
    ends = df.groupBy(*[col(i).alias(f"_shared_{n}") for n, i in enumerate(ids)]).agg(F.min(split).alias("_low"), F.max(split).alias("_high"))
    twice = materialise(ends.filter(F.col("_low") != F.col("_high")).drop("_low", "_high"), "shared-ids")
    same = [col(i).eqNullSafe(F.col(f"_shared_{n}")) for n, i in enumerate(ids)]
    shared = df.join(twice, same, "left_semi").groupBy(*ids).agg(F.array_sort(F.collect_set(split)).alias("_splits"))
    text = F.concat_ws("|", *[col(i).cast("string") for i in ids])
    pairs = shared.select(text.alias("_id"), "_splits", F.posexplode("_splits").alias("_at", "left_split")).select(
        "_id", "left_split", F.explode(F.slice("_splits", F.col("_at") + 2, F.size("_splits"))).alias("right_split")
    )
    return pairs.groupBy("left_split", "right_split").agg(
        F.count(F.lit(1)).alias("shared_ids"), F.min("_id").alias("example")
    )


def pair_names(new: Sequence[str], others: Sequence[str]) -> list[tuple[str, str]]:
    """Every candidate against every other column: new x all, never all x all."""
    return [(a, b) for a in new for b in others if a != b]
