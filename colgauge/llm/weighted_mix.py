"""Mixing of sources to target weights, by budgets handed down a tree.

Documents are the leaves' stock in a tree of domain, language and source. A token budget enters at the root.
At every node it is shared among the children by weight; no child gets more than its stock times
the number of epochs allows, and what it cannot take goes to its siblings by their weights. As the
stock of an inner node is that of its leaves, a shortage is first made good among siblings, and only what
a whole branch cannot take goes to the branches of the ancestor above. The level that fills each family is found
with running sums over the children in the order of stock per weight, so any number of nodes will do.

A leaf whose target is e times its stock and a rest gives e whole epochs and, of one more, the
longest prefix that the rest pays for, in an order drawn from seed, epoch, id and text. The prefix is found
by summing tokens over hash ranges, the range where it ends is cut finer, and only its last range is
read row by row; documents are then taken where they lie, without moving a text. Rows of one id and text
share a draw; where the prefix ends among them, they are numbered and as many go in as are paid for. What is
left of a leaf's target is less than its next document.

Defined results: a NULL domain, language or source is a branch of its own, named by an empty text;
a node without a weight has weight 1, one with weight 0 or less gets nothing; a NULL text has no tokens;
a NULL id is drawn by its text; an empty table or leaf gives nothing. Other columns are kept, one named as the
epoch's is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from colgauge.llm.common import query, table, whole_text
from colgauge.operators.order import running_totals
from colgauge.session import materialise

EPOCHS = 2          # times a document may be used
SEED = 17
SHARE = 1.0         # budget as a share of all tokens
# The target weights of the registered query by path from the root, "*" for any name: domains, languages in each, sources alike.
WEIGHTS = {("d0",): 0.4, ("d1",): 0.3, ("d2",): 0.2, ("d3",): 0.1, ("*", "en"): 0.6, ("*", "de"): 0.15, ("*", "fr"): 0.15, ("*", "es"): 0.1}

_RANGES = 1024      # hash ranges of a step
_BITS = 60


def tokens_of(text: str | Column) -> Column:
    """Words of a text, which stand for its tokens."""
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def identity(doc_id: Column, text: Column) -> Column:
    """What a document is drawn by: its id and its text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(whole_text(text)))


def draw(seed: int, epoch: Column, name: Column) -> Column:
    """A number of 60 bits that orders the documents of an epoch."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def weight_of(weights: Mapping[str | tuple, float], levels: Sequence[str]) -> Column:
    """The weight of a node: that of its path, else that of the path with ``*`` for the names above it or for all; else 1.

    A plain name is a path of one name, so no source takes the weight of a domain that is called the same.
    """
    depth = len(levels)
    given = {(k,) if isinstance(k, str) else tuple(k): w for k, w in weights.items()}
    given = {k: w for k, w in given.items() if len(k) == depth}
    if not given:
        return F.lit(1.0)
    join = lambda names: F.concat_ws("\x1f", *names)
    known = F.create_map(*[F.lit(x) for k, w in given.items() for x in ("\x1f".join(k), float(w))])
    paths = [[F.lit("*")] * stars + [F.col(c) for c in levels[stars:]] for stars in range(depth + 1)]
    return F.coalesce(*[F.try_element_at(known, join(path)) for path in paths], F.lit(1.0))


def share_out(children: DataFrame, parent: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Adds ``fill``: the part of the parent's ``budget`` that each child gets, by ``weight`` up to ``stock``."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    upto = family.orderBy("_level", *by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = children.withColumn("_level", F.when(F.col("weight") > 0, F.col("stock") / F.col("weight")))
    live = rows.withColumns({"_w": F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0), "_c": F.when(F.col("weight") > 0, F.col("stock")).otherwise(0.0)})
    sums = live.withColumns({"_all": F.sum("_w").over(family), "_wsum": F.sum("_w").over(upto), "_csum": F.sum("_c").over(upto)})
    # A child is full if the budget reaches the level at which it is.
    full = sums.withColumn("_full", F.coalesce(F.col("_csum") + F.col("_level") * (F.col("_all") - F.col("_wsum")) <= F.col("budget"), F.lit(False)))
    rest = full.withColumns({"_taken": F.sum(F.when(F.col("_full"), F.col("_c")).otherwise(0.0)).over(family),
                             "_open": F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(family)})
    fill = F.when(F.col("_full"), F.col("_c")).when(F.col("_w") > 0, F.least(
        F.col("_c"), F.col("_w") * (F.col("budget") - F.col("_taken")) / F.col("_open"))).otherwise(0.0)
    return rest.withColumn("fill", F.greatest(fill, F.lit(0.0))).select(*children.columns, "fill")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str | tuple, float], budget: Column, epochs: int) -> DataFrame:
    """(levels, tokens, target): what each leaf of (levels, tokens) is to give."""
    stocked = leaves.withColumn("stock", F.col("tokens") * F.lit(float(epochs)))
    above = None
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = stocked.groupBy(*path).agg(F.sum("stock").alias("stock"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", weight_of(weights, path).cast("double"))
        nodes = nodes.withColumn("budget", budget) if above is None else nodes.join(above, parent)
        filled = share_out(nodes, parent, path)
        above = filled.select(*path, F.col("fill").alias("budget"))
    return filled.select(*levels, "tokens", F.floor(F.col("fill") + F.lit(1e-6)).cast("long").alias("target"))


def prefix_ends(stock: DataFrame, leaf: Sequence[str], rest: str) -> DataFrame:
    """(leaf, edge, room): the first draw of each leaf that its rest does not pay for as a whole, and for how many of its rows it does.

    ``stock`` has a row for each document: leaf, ``draw``, ``tokens`` and the tokens of ``rest`` to be spent.
    """
    shift, before = _BITS, F.lit(0).cast("long")
    rows = stock.select(*leaf, "draw", "tokens", F.col(rest).alias("_rest"), before.alias("_spent"))
    for _ in range(2):
        shift -= 10
        here = F.shiftright("draw", shift)
        sums = rows.groupBy(*leaf, here.alias("_range")).agg(
            F.sum("tokens").alias("_sum"), F.first("_rest").alias("_rest"), F.first("_spent").alias("_spent"))
        order = Window.partitionBy(*leaf).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("_upto", F.col("_spent") + F.sum("_sum").over(order)).filter(F.col("_upto") > F.col("_rest"))
        edge = run.groupBy(*leaf).agg(F.min("_range").alias("_range"), F.min(F.col("_upto") - F.col("_sum")).alias("_before"))
        # The sums before the first range that is not affordable are the smallest of those kept.
        rows = rows.join(edge, list(leaf)).filter(here == F.col("_range")).select(
            *leaf, "draw", "tokens", "_rest", F.col("_before").alias("_spent"))
    each = rows.groupBy(*leaf, "draw").agg(
        F.sum("tokens").alias("_sum"), F.max("tokens").alias("_each"), F.first("_rest").alias("_rest"), F.first("_spent").alias("_spent"))
    order = Window.partitionBy(*leaf).orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = each.withColumn("_upto", F.col("_spent") + F.sum("_sum").over(order)).filter(F.col("_upto") > F.col("_rest"))
    first = run.groupBy(*leaf).agg(F.min(F.struct("draw", F.floor((F.col("_rest") - F.col("_upto") + F.col("_sum")) / F.col("_each")).alias("room"))).alias("_e"))
    return first.select(*leaf, F.col("_e.draw").alias("edge"), F.col("_e.room").cast("long").alias("room"))


def mix(
    docs: DataFrame, levels: Sequence[Column], weights: Mapping[str | tuple, float], share: float = SHARE, id_col: str = "doc_id",
    text: str = "text", epochs: int = EPOCHS, seed: int = SEED, epoch: str | None = None,
) -> DataFrame:
    """``docs`` as often as each is used, all columns kept; ``epoch`` names a column for its number, from 0 on.

    ``levels`` gives the branch of a document from the root down; the budget is ``share`` of all its tokens.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    path = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(levels, names)]
    name = identity(F.col(id_col), F.col(text)).alias("_name")
    stock = materialise(docs.select(*path, name, tokens_of(text).alias("tokens")), "stock")
    leaves = materialise(stock.groupBy(*names).agg(F.sum("tokens").cast("long").alias("tokens")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    targets = budgets(leaves, names, weights, F.floor(F.lit(total * float(share))).cast("double"), epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(0).cast("int")
    plan = materialise(targets.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("tokens")).select(
        *names, "_whole", "_rest"), "targets")
    drawn = stock.join(plan, names).withColumn("draw", draw(seed, F.col("_whole"), F.col("_name")))
    ends = prefix_ends(drawn, names, "_rest")
    # Without an edge nothing of the partial epoch is paid for.
    plan = materialise(plan.join(ends, names, "left").select(
        *names, "_whole", F.coalesce("edge", F.lit(-1)).alias("_edge"), F.coalesce("room", F.lit(0)).alias("_room")), "targets")
    rows = docs.select(F.struct("*").alias("_row"), *path, name).join(plan, names)
    rows = rows.withColumn("_draw", draw(seed, F.col("_whole"), F.col("_name")))
    times = F.col("_whole") + (F.col("_draw") < F.col("_edge")).cast("int")
    taken = rows.withColumn("_times", times).filter(F.col("_times") > 0)
    taken = taken.select("_row", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("_at"))
    # Equal rows are counted before they are numbered, so any number of them may stand at an edge.
    edge = rows.filter((F.col("_draw") == F.col("_edge")) & (F.col("_room") > 0)).groupBy(*names, F.to_json("_row").alias("_text")).agg(
        F.first("_row").alias("_row"), F.first("_whole").alias("_at"), F.first("_room").alias("_room"), F.count(F.lit(1)).alias("_n"))
    numbered = running_totals(edge, names, "_text", ["_n"]).withColumn("_take", F.least("_n", F.col("_room") - F.col("_n_before")))
    paid = numbered.filter(F.col("_take") > 0).select("_row", "_at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_take")))).select("_row", "_at")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c != epoch]
    return taken.union(paid).select(*kept, *([F.col("_at").alias(epoch)] if epoch else []))


def domain(source: str | Column) -> Column:
    """The domain of a source: its number modulo 4; an empty text where it has none."""
    c = F.col(source) if isinstance(source, str) else source
    number = F.try_to_number(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{1,9})$", 1), F.lit("999999999"))
    return F.coalesce(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")), F.lit(""))


def _shared(parent: str, path: str, name: str, budget: str) -> str:
    over = f"PARTITION BY {parent}" if parent else ""
    run = f"{over} ORDER BY stock / weight, {path} ROWS UNBOUNDED PRECEDING"
    return f"""{name} AS (SELECT *, CASE WHEN isfull THEN stock
    ELSE weight * (budget - sum(CASE WHEN isfull THEN stock ELSE 0 END) OVER ({over}))
      / sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER ({over}) END AS fill
  FROM (SELECT *, sum(stock) OVER ({run}) + stock / weight * (sum(weight) OVER ({over}) - sum(weight) OVER ({run})) <= budget AS isfull
        FROM ({budget})))"""


def _weight(column: str, depth: int) -> str:
    cases = " ".join(f"WHEN '{k[-1]}' THEN {v}" for k, v in WEIGHTS.items() if len(k) == depth)
    return f"CASE {column} {cases} ELSE 1.0 END" if cases else "1.0"


OP1_SQL = f"""WITH d AS (
  SELECT doc_id, coalesce('d' || (TRY_CAST(regexp_extract(coalesce(source, ''), '(\\d{{1,9}})$', 1) AS BIGINT) % 4), '') AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n, doc_id || ':' || md5(coalesce(text, '')) AS name FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens, {float(EPOCHS)} * CAST(sum(n) AS DOUBLE) AS stock FROM d GROUP BY ALL),
total AS (SELECT CAST(floor(sum(n) * {SHARE}) AS DOUBLE) AS budget FROM d),
{_shared('', 'domain', 'a', f"SELECT domain, sum(stock) AS stock, CAST({_weight('domain', 1)} AS DOUBLE) AS weight, any_value(budget) AS budget FROM leaf, total GROUP BY domain")},
{_shared('domain', 'lang', 'b', f"SELECT l.domain, l.lang, sum(l.stock) AS stock, CAST({_weight('l.lang', 2)} AS DOUBLE) AS weight, any_value(a.fill) AS budget FROM leaf l JOIN a USING (domain) GROUP BY l.domain, l.lang")},
{_shared('domain, lang', 'source', 'c', f"SELECT l.*, CAST({_weight('l.source', 3)} AS DOUBLE) AS weight, b.fill AS budget FROM leaf l JOIN b USING (domain, lang)")},
t AS (SELECT domain, lang, source, CAST(CASE WHEN tokens > 0 THEN floor(floor(fill + 1e-6) / tokens) ELSE 0 END AS INTEGER) AS whole,
             floor(fill + 1e-6) - CASE WHEN tokens > 0 THEN floor(floor(fill + 1e-6) / tokens) ELSE 0 END * tokens AS rest FROM c),
k AS (SELECT d.*, t.whole, t.rest, CAST('0x' || substr(md5('{SEED}:' || t.whole || ':' || d.name), 1, 15) AS BIGINT) AS draw
      FROM d JOIN t USING (domain, lang, source)),
r AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY draw) AS upto FROM k),
f AS (SELECT *, coalesce(draw < min(CASE WHEN upto > rest THEN draw END) OVER (PARTITION BY domain, lang, source), false) AS part FROM r)
SELECT doc_id, domain, lang, source, CAST(unnest(range(whole + CAST(part AS INTEGER))) AS INTEGER) AS epoch FROM f"""


@query("op1_weighted_mix", OP1_SQL)
def op1_weighted_mix(spark, folder):
    docs = table(spark, folder, "documents").withColumn("domain", domain("source"))
    done = mix(docs, [F.col("domain"), F.col("lang"), F.col("source")], WEIGHTS, epoch="epoch")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return done.select("doc_id", "domain", empty("lang"), empty("source"), "epoch")
