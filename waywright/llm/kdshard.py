"""Shards of near-equal bytes by k-d tree partitioning over metadata, in DataFrame operations only.

Each value of a dimension gets a place: the share of all bytes that lie at smaller values, so
that widths of different dimensions compare.  Every row has one 62-bit key a dimension: the
place and, below it, a hash of its text, so that equal texts lie together and ties can be cut.
A level of the tree splits all its nodes at once: each node takes its widest dimension, and
its weighted median is found by counting bytes by the next digits of the key, a few rounds of
small histograms.  Nodes, histograms and cuts are tables; the driver gets a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

PLACE_BITS, TIE_BITS = 20, 42
DIGIT = 10
#: A median may miss by this share of its node's bytes before finer digits are counted.
TOLERANCE = 2e-4
#: Rows of a shard that are numbered together.
NUMBERED = 1_000
#: A text whose copies outweigh a fair shard is cut into pieces of this share of one.
PIECE = 1 / 16
#: Tables of up to so many rows (a node of the tree, or a value of a dimension, each) are broadcast.
MOST_BROADCAST = 20_000


def _value(column: str, kind: T.DataType) -> Column:
    """The value that a dimension is ordered by: a number (NaN counts as null), else the whole text."""
    c = F.col(column)
    if isinstance(kind, T.NumericType):
        value = c.cast("double")
        return F.when(~F.isnan(value), value)
    return c.cast("string")


def _fitting(table: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most MOST_BROADCAST rows, else joined by shuffles."""
    return F.broadcast(table) if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else table.hint("merge")


def _places(texts: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """(value, place) of a dimension: the bytes of all smaller values, in 2^PLACE_BITS-ths of all bytes; null lies lowest.

    Distinct values are dealt out by range; a range's bytes and those of the ranges before it add up to the prefix sums.
    """
    values = texts.groupBy(F.col(name).alias("value")).agg(F.sum("bytes").alias("bytes"))
    dealt = scratch.cut(values.repartitionByRange(F.col("value").asc_nulls_first()).withColumn("range", F.spark_partition_id()), f"values-{name}")
    ranges = dealt.groupBy("range").agg(F.sum("bytes").alias("in_range"))
    upto = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each range
    ranges = ranges.select("range", (F.sum("in_range").over(upto) - F.col("in_range")).alias("before"), F.sum("in_range").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = Window.partitionBy("range").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("within", F.sum("bytes").over(inside) - F.col("bytes")).join(F.broadcast(ranges), "range")
    share = (F.col("before") + F.col("within")) / F.col("total")
    return scratch.cut(summed.select("value", F.floor(share * ((1 << PLACE_BITS) - 1)).cast("long").alias("place")), f"places-{name}")


def _key(dim: Column) -> Column:
    return F.element_at("keys", dim + 1)


def _cuts(rows: DataFrame, open_nodes: DataFrame, n_dims: int, scratch: Scratch, level: int) -> DataFrame:
    """(node, first, shards, dim, cut) of each node to be split: its widest dimension and the last key that goes left."""
    mine = rows.join(_fitting(open_nodes), "node")
    places = [F.shiftright(F.col("keys")[d], TIE_BITS) for d in range(n_dims)]
    found = mine.groupBy("node", "first", "shards").agg(F.sum("size").alias("bytes"), *[(F.max(p) - F.min(p)).alias(f"w{d}") for d, p in enumerate(places)])
    widest = F.greatest(*[F.col(f"w{d}") for d in range(n_dims)]) if n_dims > 1 else F.col("w0")
    dim = F.coalesce(*[F.when(F.col(f"w{d}") == widest, F.lit(d)) for d in range(n_dims)])
    goal = F.col("bytes") * F.floor(F.col("shards") / 2) / F.col("shards")
    state = found.select("node", "first", "shards", "bytes", dim.alias("dim"), goal.alias("goal"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"), F.lit(None).cast("long").alias("cut"))
    state = scratch.cut(state, f"state-{level}-0")
    shift, step = PLACE_BITS + TIE_BITS, 0
    while shift and state.filter("cut is null").limit(1).count():
        digits = min(DIGIT, shift)
        shift -= digits
        step += 1
        asked = state.filter("cut is null").select("node", "dim", "prefix")
        now = rows.join(_fitting(asked), "node").withColumn("k", _key(F.col("dim"))).filter(F.shiftright("k", shift + digits) == F.col("prefix"))
        bins = now.groupBy("node", F.shiftright("k", shift).alias("bin")).agg(F.sum("size").alias("in_bin"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 1024 bins a node at most
        sums = bins.withColumn("sum", F.sum("in_bin").over(upto)).join(_fitting(state.select("node", "goal", "below", "bytes")), "node")
        # The bin in which the median lies: the first to reach the goal, else the last.
        rank = F.struct((F.col("below") + F.col("sum") < F.col("goal")).cast("int").alias("short"), F.when(F.col("below") + F.col("sum") < F.col("goal"), -F.col("bin")).otherwise(F.col("bin")).alias("nth"))
        at = sums.groupBy("node").agg(F.min_by(F.struct("bin", "in_bin", "lo", "hi", (F.col("below") + F.col("sum") - F.col("in_bin")).alias("before"), "goal", "bytes"), rank).alias("b"))
        near_end = F.col("b.goal") - F.col("b.before") > F.col("b.before") + F.col("b.in_bin") - F.col("b.goal")
        last = (F.col("b.lo") == F.col("b.hi")) | F.lit(shift == 0) | (F.col("b.in_bin") <= TOLERANCE * F.col("b.bytes"))
        at = at.select("node", F.col("b.before").alias("new_below"), F.col("b.bin").alias("new_prefix"), F.when(last, F.when(near_end, F.col("b.hi")).otherwise(F.shiftleft(F.col("b.bin"), shift) - 1)).alias("new_cut"))
        state = state.join(at, "node", "left").select("node", "first", "shards", "bytes", "dim", "goal", F.coalesce("new_below", "below").alias("below"), F.coalesce("new_prefix", "prefix").alias("prefix"), F.coalesce("cut", "new_cut").alias("cut"))
        state = scratch.cut(state, f"state-{level}-{step}")
        scratch.drop(f"state-{level}-{step - 1}")
    return state.select("node", "first", "shards", "dim", "cut")


def kd_shards(docs: DataFrame, dims: tuple[str, ...], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Put every row into one of ``shards`` leaves, or as many as ``target_bytes`` asks for, of near-equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard (from 0) and slot
    (gapless from 0 in each shard, in the order of a hash of the id).  Rows with equal texts
    share a shard, with the metadata of the one with the smallest id, unless their bytes alone
    outweigh a fair shard; such texts are cut by a hash of the id.  Numbers are ordered as
    numbers (NaN as null), anything else as whole texts; null metadata lies lowest.  A null
    text counts as empty, repeated rows are separate rows, other columns are ignored, and an
    empty table gives an empty result.  If there are fewer distinct texts than shards, some stay empty.
    """
    scratch = Scratch(docs.sparkSession, "kdshard")
    kinds = dict(zip(docs.columns, (f.dataType for f in docs.schema.fields), strict=True))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"c{i}" for i in range(len(dims))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"), *[_value(d, kinds[d]).alias(c) for d, c in zip(dims, names, strict=True)])
    rows = scratch.cut(rows, "rows")

    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    count = shards or max(1, -(-total // target_bytes))
    fair = max(1.0, total / count)
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *names))
    texts = scratch.cut(
        rows.groupBy("same").agg(F.sum("size").alias("bytes"), one.alias("m")).select("same", "bytes", F.when(F.col("bytes") > fair, F.ceil(F.col("bytes") / (fair * PIECE))).otherwise(1).alias("pieces"), *[F.col(f"m.{c}").alias(c) for c in names]),
        "texts",
    )
    placed = texts.select("same", "pieces", *names)
    for i, c in enumerate(names):
        where = _fitting(_places(texts, c, scratch)).withColumnsRenamed({"value": f"of{i}", "place": f"p{i}"})
        placed = placed.join(where, F.col(c).eqNullSafe(F.col(f"of{i}"))).drop(f"of{i}")
    placed = scratch.cut(placed.select("same", "pieces", *[f"p{i}" for i in range(len(dims))]), "text-places")
    tie = F.when(F.col("pieces") == 1, F.xxhash64(F.col("same"))).otherwise(F.xxhash64("same", F.pmod(F.xxhash64("doc_id"), F.col("pieces"))))
    tie = F.shiftrightunsigned(tie, 64 - TIE_BITS)
    keys = [F.shiftleft(F.col(f"p{i}"), TIE_BITS).bitwiseOR(tie) for i in range(len(dims))]
    placed = rows.drop(*names).join(placed, "same").select("doc_id", "size", "text_crc32", F.lit(0).cast("long").alias("node"), F.array(*keys).alias("keys"))
    placed = scratch.cut(placed, "placed-0")
    scratch.drop("texts", "text-places")

    # Levels: of a node's shards, the first half goes left.
    nodes = docs.sparkSession.range(1).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("first"), F.lit(count).cast("long").alias("shards"))
    level = 0
    while n and count > 1 << level:
        cuts = scratch.cut(_cuts(placed, nodes.filter("shards > 1"), len(dims), scratch, level), f"cuts-{level}")
        deeper = placed.join(_fitting(cuts.select("node", "dim", "cut")), "node", "left")
        right = F.coalesce((_key(F.col("dim")) > F.col("cut")).cast("long"), F.lit(0))
        placed = scratch.cut(deeper.select("doc_id", "size", "text_crc32", (2 * F.col("node") + right).alias("node"), "keys"), f"placed-{level + 1}")
        scratch.drop(f"placed-{level}")
        half = F.floor(F.col("shards") / 2)
        sides = cuts.select(F.explode(F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("first").alias("first"), half.alias("shards")),
            F.struct((2 * F.col("node") + 1).alias("node"), (F.col("first") + half).alias("first"), (F.col("shards") - half).alias("shards")),
        )).alias("x")).select("x.*")
        leaves = nodes.join(cuts.select("node"), "node", "left_anti").select((2 * F.col("node")).alias("node"), "first", F.lit(1).cast("long").alias("shards"))
        nodes = scratch.cut(sides.unionByName(leaves), f"nodes-{level + 1}")
        level += 1

    blocks = max(1, -(-n // (count * NUMBERED)))
    out = placed.join(_fitting(nodes.select("node", "first")), "node").select("doc_id", "size", "text_crc32", F.col("first").cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    out = scratch.cut(out, "sharded")
    scratch.drop(f"placed-{level}", "rows")
    counts = out.groupBy("shard", "block").agg(F.count("*").alias("in_block"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")
    numbered = out.withColumn("place", F.row_number().over(inside))
    return numbered.join(bases, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"))
