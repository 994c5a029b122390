"""Mixing sources to target weights: budgets down a tree, shortages to siblings first, prefixes of seeded epochs.

The tree's levels are columns.  A node's budget goes to its children in proportion to their
weights, up to what each holds (its leaves' tokens, times the epochs allowed); what a child
can't take its siblings share by weight, and only what all siblings can't take is left to
the level above, whose own sharing has allowed for it.  Leaves then take whole epochs and a
prefix of one more, in an order that the seed, the epoch and the document's id give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Hexadecimal digits of the order that prefix sums are taken by first.
DIGITS = 3
#: A plan is broadcast up to this many leaves, and joined without a hint beyond.
MOST_BROADCAST = 20_000


def tokens_of(text: str = "text") -> Column:
    """A token count that needs no vocabulary: a quarter of the UTF-8 bytes, rounded up; 0 for a null text."""
    return F.coalesce(F.ceil(F.octet_length(F.col(text).cast("string")) / 4), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch: a hash as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def share_out(children: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Add ``budget`` to rows (parent columns, own, weight, room, parent_budget): capped shares that add up exactly.

    Children are taken by how soon they fill up (room over weight); those that a fair share
    fills take their room, the others split the rest by weight with cumulative rounding.
    Whole numbers throughout: room times the weights' sum must stay below 2^63.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    w, room = F.col("weight"), F.col("room")
    queue = by.orderBy((room / w).asc(), *order)
    upto = queue.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = children.filter("weight > 0")
    whole = whole.withColumn("_before", F.sum("room").over(upto) - room).withColumn("_from", F.sum("weight").over(by) - F.sum("weight").over(upto) + w)
    whole = whole.withColumn("_full", room * F.col("_from") <= (F.col("parent_budget") - F.col("_before")) * w)
    rest = F.greatest(F.lit(0), F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("_full"), room)).over(by), F.lit(0)))
    whole = whole.withColumn("_rest", rest).withColumn("_loose", F.when(F.col("_full"), 0).otherwise(w))
    whole = whole.withColumn("_sum", F.sum("_loose").over(by)).withColumn("_run", F.sum("_loose").over(upto))
    part = F.expr("_rest * _run div _sum - _rest * (_run - _loose) div _sum")
    return whole.withColumn("budget", F.when(F.col("_full"), room).otherwise(part)).drop("_before", "_from", "_full", "_rest", "_loose", "_sum", "_run")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """(levels, tokens, budget) of each leaf, from (levels, tokens); the root gets ``share`` of all tokens."""
    base = leaves.withColumn("room", F.col("tokens") * max_epochs)
    down = base.agg(F.expr(f"coalesce(sum(tokens), 0) * {share[0]} div {share[1]}").alias("parent_budget"))
    for i, level in enumerate(levels):
        path = levels[: i + 1]
        nodes = base.groupBy(*path).agg(F.sum("room").alias("room")).withColumn("weight", weights.get(level, F.lit(1)).cast("long"))
        nodes = nodes.crossJoin(F.broadcast(down)) if i == 0 else nodes.join(down, levels[:i])  # one row: the root
        down = share_out(nodes, levels[:i], [level]).select(*path, F.col("budget").alias("parent_budget"))
    return leaves.join(down, levels).select(*levels, "tokens", F.col("parent_budget").alias("budget"))


def plan(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], share: tuple[int, int], max_epochs: int = 1, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """One row a leaf: its path, tokens, budget, whole epochs, and the last (key, doc_id) of the prefix, null if there is none.

    ``levels`` names the tree's levels and gives their columns from documents, root first; a
    null is an empty name.  ``weights`` are whole numbers by level, in terms of the path's
    columns, 1 if not given; weight 0 takes nothing.  Prefix sums run over groups of the order's first digits,
    and document by document only inside the group where a leaf's prefix ends.  A null text
    holds no tokens, repeated rows count each, other columns are ignored, and an empty table
    gives a plan without rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names = list(levels)
    count = tokens_of() if tokens is None else tokens
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count.alias("tokens"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()])
    rows = scratch.cut(rows, "rows")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    shares = budgets(leaves, names, weights, share, max_epochs).withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("more", F.col("budget") - F.col("epochs") * F.col("tokens"))
    shares = scratch.cut(shares, "shares")
    wanted = _fitting(shares.filter("more > 0").select(*names, "epochs", "more"))
    keyed = rows.join(wanted, names).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id"))).withColumn("head", F.substring("key", 1, DIGITS))
    sums = keyed.groupBy(*names, "head").agg(F.sum("tokens").alias("tokens"), F.first("more").alias("more"))
    before = Window.partitionBy(*names).orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("before", F.sum("tokens").over(before) - F.col("tokens")).filter("before < more and before + tokens >= more and tokens > 0")
    ends = scratch.cut(sums.select(*names, "head", "before"), "ends")
    last = keyed.join(_fitting(ends), [*names, "head"])
    run = Window.partitionBy(*names).orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.col("before") + F.sum("tokens").over(run) - F.col("tokens")).filter("upto < more")
    cuts = last.groupBy(*names).agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"))).alias("last"))
    found = scratch.cut(shares.join(cuts, names, "left").select(*names, "tokens", "budget", "epochs", F.col("last.key").alias("last_key"), F.col("last.doc_id").alias("last_id")), "plan")
    scratch.drop("rows", "shares", "ends")
    return found


def _fitting(leaves: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most MOST_BROADCAST rows."""
    return F.broadcast(leaves) if leaves.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else leaves


def apply_plan(docs: DataFrame, leaves: DataFrame, levels: dict[str, Column], seed: int = 0) -> DataFrame:
    """Documents that the plan takes, with all their columns and ``mix_epochs``, how often each is taken.

    The documents aren't shuffled.  Empty texts hold no tokens and are taken with the prefix
    that passes them.  Repeated rows lie together in the order and are taken together.  A column
    mix_epochs of the documents' own is replaced; other names may clash with the levels'.  An
    empty table, or an empty plan, gives no rows.
    """
    names = list(levels)
    keyed = docs.withColumns({f"_mix_{n}": F.coalesce(c.cast("string"), F.lit("")) for n, c in levels.items()})
    small = _fitting(leaves.select(*[F.col(n).alias(f"_mix_{n}") for n in names], F.col("epochs").alias("_mix_whole"), F.col("last_key").alias("_mix_key"), F.col("last_id").alias("_mix_id")))
    joined = keyed.join(small, [f"_mix_{n}" for n in names])
    own = F.struct(order_key(seed, F.col("_mix_whole"), F.col("doc_id").cast("long")), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    inside = F.coalesce(own <= F.struct("_mix_key", "_mix_id"), F.lit(False)) & F.col("_mix_key").isNotNull()
    taken = joined.drop("mix_epochs").withColumn("mix_epochs", (F.col("_mix_whole") + inside.cast("int")).cast("long")).filter("mix_epochs > 0")
    return taken.select(*[c for c in docs.columns if c != "mix_epochs"], "mix_epochs")
