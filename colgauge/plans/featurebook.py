"""Users' own links, aggregates and features, as functions of DataFrames with a checked result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from colgauge.functions.scalars import col
from colgauge.operators.aggregate import PERIOD_END, add_period_end, moved_periods
from colgauge.operators.guards import require_grain
from colgauge.operators.linkage import attach_feature, check_linkage, link_aggregate
from colgauge.session import materialise


class FeatureBook:
    """Sources, how they link to the model rows, and the features built on them.

    Each link and aggregate is computed once, written, and shared by every feature
    that reads it. A link that lets through events on or after the as-of date, an
    aggregate off its grain or a feature that is not one row per id is refused.
    """

    def __init__(self, ids: DataFrame, id_col: str = "id", as_of: str = "as_of"):
        self.ids, self.id_col, self.as_of = ids, id_col, as_of
        self._sources: dict[str, DataFrame] = {}
        self._links: dict[str, tuple[Callable, str, str]] = {}
        self._aggregates: dict[str, tuple[str, Callable, str, tuple[str, ...], str]] = {}
        self._features: dict[str, Callable] = {}
        self._made: dict[str, DataFrame] = {}

    def register_source(self, name: str, df: DataFrame) -> None:
        self._sources[name] = df

    def register_link(self, source: str, fn: Callable[[DataFrame, DataFrame], DataFrame], time: str, rule: str = "strict") -> None:
        """``fn(ids, source)`` gives (id, as_of, source columns) rows."""
        self._links[source] = (fn, time, rule)

    def register_aggregate(
        self, name: str, source: str, fn: Callable[[DataFrame], DataFrame], time: str, key: Sequence[str], period: str
    ) -> None:
        """``fn(source with period_end)`` gives one row per key and period_end."""
        self._aggregates[name] = (source, fn, time, tuple(key), period)

    def register_feature(self, name: str, fn: Callable[[Mapping[str, DataFrame], DataFrame], DataFrame]) -> None:
        """``fn(linked tables by name, ids)`` gives the id and one column."""
        self._features[name] = fn

    def linked(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._link(name) if name in self._links else self._aggregate(name)
        return self._made[name]

    def _link(self, source: str) -> DataFrame:
        fn, time, rule = self._links[source]
        linked = materialise(fn(self.ids, self._sources[source]), f"link-{source}")
        found = check_linkage(linked, self.ids, time=time, id_col=self.id_col, as_of=self.as_of, rule=rule).first()
        if found.late_rows or found.unknown_ids or found.unparsed_rows:
            raise ValueError(
                f"link {source!r}: {found.late_rows:,} rows on or after their as-of date, {found.unknown_ids:,} unknown ids, "
                f"{found.unparsed_rows:,} rows without a time"
            )
        return linked

    def _aggregate(self, name: str) -> DataFrame:
        source, fn, time, key, period = self._aggregates[name]
        events = self._sources[source]
        table = materialise(fn(add_period_end(events.filter(col(time).isNotNull()), time, period)), f"aggregate-{name}")
        if PERIOD_END not in table.columns:
            raise ValueError(f"aggregate {name!r} must keep {PERIOD_END!r}")
        repeated = table.groupBy(*key, PERIOD_END).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not repeated.isEmpty():
            raise ValueError(f"aggregate {name!r} repeats at ({', '.join(key)}, {PERIOD_END})")
        if not moved_periods(table, events, time, period).isEmpty():
            raise ValueError(f"aggregate {name!r} moved {PERIOD_END}")
        return link_aggregate(self.ids, table, key=list(key), id_col=self.id_col, as_of=self.as_of)

    def feature(self, name: str) -> DataFrame:
        return require_grain(self._features[name](_Reader(self), self.ids), self.id_col)

    def attach(self, rows: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """The rows with every named feature beside them."""
        for name in names or self._features:
            rows = attach_feature(rows, self.feature(name), self.id_col)
        return rows


class _Reader(Mapping):
    """Linked tables, made when a feature first reads them."""

    def __init__(self, book: FeatureBook):
        self._book = book

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._book._links and name not in self._book._aggregates:
            raise KeyError(f"no link or aggregate named {name!r}")
        return self._book.linked(name)

    def __iter__(self):
        return iter([*self._book._links, *self._book._aggregates])

    def __len__(self) -> int:
        return len(self._book._links) + len(self._book._aggregates)


def row_expression(df: DataFrame, name: str, expression: str, allowed: Sequence[str]) -> DataFrame:
    """One new column from an expression over allowed columns, the same in every split."""
    if name in df.columns:
        raise ValueError(f"{name!r} already exists; choose a new name")
    # Resolved against the allowed columns alone, so a target or an id cannot be read.
    df.select(*[col(c) for c in allowed]).select(F.expr(expression)).schema
    return df.withColumn(name, F.expr(expression))
