"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source. Leaf capacities (tokens times the most epochs) are summed
upwards; the total budget then flows down: a node's budget is shared among its children by weight,
and what a child can't hold is shared among its siblings by their weights until all of the node's
budget is placed. A node asks its own siblings only when its whole subtree is full, so shortages are
settled among siblings before ancestors. Children are ordered by capacity over weight; the full ones are a
prefix of that order, and one water level serves the others, so a level of the tree is one window over nodes.

A leaf takes whole epochs and then the prefix of one more. An epoch's order is the leaf's documents by
a seeded hash of (epoch, doc_id); the prefix ends before the document that would exceed the rest.
Documents are dealt to hash ranges of their leaf by that hash. Only sums of ranges are ordered, in blocks
of ranges and then blocks, and only the documents of the one range in which a leaf's prefix ends are looked
at one by one. What comes out is a row a leaf: whole epochs, that range, and the last hash that is taken. A document's
epochs then follow from its own row and its leaf's, so neither documents nor texts are shuffled.

Defined cases: null domain, language or source form a leaf of their own; null and empty texts have 0
tokens and are taken while their place in the order is before the end of the prefix; a leaf without
tokens has no budget; levels without a given weight weigh their tokens to the power alpha; rows of a leaf that
share a doc_id are taken together or not at all, a null doc_id hashes like a value; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_materialised, fits_broadcast, join_groups, materialise

RANGE_ROWS = 512
#: Ranges that are summed together before their sums are ordered.
BLOCK_RANGES = 4096
LEVELS = ["domain", "language", "source"]


def word_tokens(text: str = "text") -> Column:
    """Words of a whole text as the unit of budgets."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def level_columns(levels: Sequence[Column] | None) -> list[Column]:
    """The levels of the tree as strings named like LEVELS."""
    if levels is None:
        levels = [F.regexp_extract("source", r"^([A-Za-z]*)", 1), F.col("lang"), F.col("source")]
    return [c.cast("string").alias(n) for c, n in zip(levels, LEVELS, strict=True)]


def grouped_sources(groups: Mapping[str, Sequence[str]], other: str = "other") -> list[Column]:
    """Levels whose domain is the group that names the source."""
    domain = F.lit(other)
    for name, sources in groups.items():
        domain = F.when(F.col("source").isin(list(sources)), name).otherwise(domain)
    return [domain, F.col("lang"), F.col("source")]


def _alike(a: Sequence[str], b: str) -> Column:
    same = F.lit(True)
    for n in a:
        same &= F.col(n).eqNullSafe(F.col(f"{b}{n}"))
    return same


def _water(kids: DataFrame, parent: Sequence[str]) -> DataFrame:
    """kids (weight, capacity, given by their parent) with their own share of given as budget."""
    names = [c for c in kids.columns if c in LEVELS]
    cap = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)
    weight = F.when(F.col("capacity") > 0, F.greatest("weight", F.lit(0.0))).otherwise(0.0)
    kids = kids.withColumn("cap", cap).withColumn("w", weight).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0))
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = siblings.orderBy("ratio", *names)
    kids = kids.withColumn("given", F.least("given", F.sum("cap").over(siblings)))
    kids = kids.withColumn("left", F.col("given") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    kids = kids.withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # Compared by a hair, so that sums in another order don't decide a tie.
    kids = kids.withColumn("full", F.col("cap") * F.col("open") <= F.col("w") * F.col("left") * (1 + 1e-12))
    level = F.max(F.when(~F.col("full"), F.col("left") / F.col("open"))).over(siblings)
    return kids.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level)).select(*names, "tokens", "rows", "budget")


def budgets(
    leaves: DataFrame, budget: float | None = None, corpus_epochs: float = 1.0, max_epochs: int = 4,
    weights: Mapping[tuple, float] | None = None, alpha: float = 0.8,
) -> DataFrame:
    """leaves (LEVELS, tokens, rows) with leaf_budget, in tokens. budget None: corpus_epochs times all tokens.

    weights: path of any depth -> weight among its siblings; other nodes weigh their tokens to the power alpha.
    """
    spark = leaves.sparkSession
    total = float(leaves.agg(F.sum("tokens")).first()[0] or 0)  # one number
    given = min(corpus_epochs * total if budget is None else float(budget), total * max_epochs)
    now = None
    for depth in range(1, len(LEVELS) + 1):
        names, parent = LEVELS[:depth], LEVELS[: depth - 1]
        kids = leaves.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
        known = [(*path, float(w)) for path, w in (weights or {}).items() if len(path) == depth]
        table = spark.createDataFrame(known, ", ".join(f"w_{n} string" for n in names) + ", known double")
        kids = kids.join(F.broadcast(table), _alike(names, "w_"), "left")  # the caller's own table
        kids = kids.withColumn("weight", F.coalesce("known", F.pow(F.col("tokens").cast("double"), F.lit(alpha))))
        kids = kids.withColumn("capacity", F.col("tokens").cast("double") * max_epochs).drop("known", *[f"w_{n}" for n in names])
        if now is None:
            kids = kids.withColumn("given", F.lit(given))
        else:
            above = now.select(*[F.col(n).alias(f"p_{n}") for n in parent], F.col("budget").alias("given"))
            kids = kids.join(above, _alike(parent, "p_")).drop(*[f"p_{n}" for n in parent])
        now = _water(kids, parent)
    return now.select(*LEVELS, "tokens", "rows", F.floor(F.col("budget") + 1e-6).cast("long").alias("leaf_budget"))


def _leaf() -> Column:
    """The path as one string; nulls are absent in it, so no two paths share one."""
    return F.to_json(F.struct(*LEVELS)).alias("__leaf")


def _joined(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with their leaf's columns. A table of leaves too large to broadcast is, for its large leaves only."""
    if fits_broadcast(leaves, 256):
        return rows.join(F.broadcast(leaves), "__leaf")
    return join_groups(rows, leaves, ["__leaf"], "__rows")


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """Each row's place in its leaf's order, and the range of equal shares of all places that holds it."""
    rows = rows.withColumn("__place", F.xxhash64(F.lit(seed), "__whole", "doc_id"))
    # place div 2^32 lies in [-2^31, 2^31)
    share = (F.shiftright("__place", 32) + (1 << 31)) * F.col("__ranges") / F.lit(float(1 << 32))
    return rows.withColumn("__range", F.floor(share))


def cuts(rows: DataFrame, seed: int = 7, **options) -> DataFrame:
    """A row for each leaf that has a budget: where its prefix ends. rows, a table: doc_id, LEVELS, n_tokens, __leaf."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = materialise(leaves, "mixing-leaves")
    planned = materialise(
        budgets(leaves, **options).where("tokens > 0 AND leaf_budget > 0").select(
            _leaf(), "leaf_budget", F.expr("leaf_budget div tokens").cast("int").alias("__whole"), F.expr("leaf_budget % tokens").alias("__rest"),
            F.ceil(F.col("rows") / RANGE_ROWS).alias("__ranges"), F.col("rows").alias("__rows"),
        ),
        "mixing-plan",
    )
    placed = _placed(_joined(rows, planned), seed)
    ranges = placed.groupBy("__leaf", "__range").agg(F.sum("n_tokens").alias("n"), F.first("__rest").alias("__rest"))
    ranges = materialise(ranges.withColumn("block", F.expr(f"__range div {BLOCK_RANGES}")), "mixing-ranges")

    def before(by: list[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = ranges.groupBy("__leaf", "block").agg(F.sum("n").alias("n")).withColumn("blocks", before(["__leaf"], "block"))
    ordered = ranges.withColumn("inside", before(["__leaf", "block"], "__range")).join(blocks.select("__leaf", "block", "blocks"), ["__leaf", "block"])
    ordered = ordered.withColumn("before", F.col("blocks") + F.col("inside"))
    ends = ordered.where("before + n > __rest").groupBy("__leaf").agg(F.min_by(F.struct("__range", "before"), "__range").alias("end"))
    ended = planned.join(ends, "__leaf").select("*", F.col("end.__range").alias("__end"), F.col("end.before").alias("before")).drop("end")
    ended = materialise(ended, "mixing-ends")
    # The rest is less than the leaf's tokens, so each leaf has such a range. Equal places are one.
    last = _placed(_joined(rows, ended), seed).where("__range = __end").groupBy("__leaf", "__place")
    last = last.agg(F.sum("n_tokens").alias("n"), F.first("before").alias("before"), F.first("__rest").alias("__rest"))
    last = last.withColumn("inside", F.sum("n").over(Window.partitionBy("__leaf").orderBy("__place"))).where("before + inside <= __rest")
    last = last.groupBy("__leaf").agg(F.max("__place").alias("__last"))
    made = materialise(ended.join(last, "__leaf", "left").select("__leaf", "leaf_budget", "__whole", "__ranges", "__rows", "__end", "__last"), "mixing-cuts")
    for table in (leaves, planned, ranges, ended):
        drop_materialised(table)
    return made


def _epochs(rows: DataFrame, ends: DataFrame, seed: int) -> DataFrame:
    """rows that are taken, and how often (epochs)."""
    taken = (F.col("__range") < F.col("__end")) | ((F.col("__range") == F.col("__end")) & (F.col("__place") <= F.col("__last")))
    epochs = F.col("__whole") + F.when(taken, 1).otherwise(0)
    return _placed(_joined(rows, ends), seed).withColumn("__epochs", epochs.cast("int")).where("__epochs > 0")


def _rows(docs: DataFrame, levels: Sequence[Column] | None, tokens: Column | None) -> DataFrame:
    rows = docs.select("doc_id", *level_columns(levels), (word_tokens() if tokens is None else tokens).cast("long").alias("n_tokens"))
    return materialise(rows.withColumn("__leaf", _leaf()), "mixing-rows")  # no texts from here on


def mix(docs: DataFrame, levels: Sequence[Column] | None = None, tokens: Column | None = None, seed: int = 7, **options) -> DataFrame:
    """(doc_id, domain, language, source, n_tokens, epochs, leaf_budget): documents taken, and how often. options: budgets()."""
    rows = _rows(docs, levels, tokens)
    taken = _epochs(rows, cuts(rows, seed, **options), seed)
    return taken.select("doc_id", *LEVELS, "n_tokens", F.col("__epochs").alias("epochs"), "leaf_budget")


def mixed_documents(docs: DataFrame, levels: Sequence[Column] | None = None, tokens: Column | None = None, seed: int = 7, **options) -> DataFrame:
    """docs with each taken document as often as its epochs say; documents that aren't taken go."""
    ends = cuts(_rows(docs, levels, tokens), seed, **options).drop("leaf_budget")
    placed = docs.withColumn("__leaf", F.to_json(F.struct(*level_columns(levels))))
    taken = _epochs(placed, ends, seed).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__epochs")))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
