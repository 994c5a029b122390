"""Near-duplicate grouping: SuperMinHash signatures, banding, verification, components.

How it scales: a document is sketched where it is read.  Documents with the same
shingle set share one vertex from then on, so copies, however many, cost one row each.
A band's bucket names a hub (its smallest vertex); each vertex is verified against its
smallest hub, which settles large groups with one comparison a member.  Where a bucket's
vertices still lie in different components, those that agree by signature make clusters,
and a cluster's components are compared on full sets, in blocks, with union-find in each
block: what a block returns is a forest, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import without_collector
from .components import components
from .scratch import Scratch

BANDS, ROWS = 36, 5  # a link at similarity 0.8 shares no bucket with probability (1 - 0.8^5)^36 < 1e-6
SLOTS = BANDS * ROWS
SLICE = 128
BLOCK = 512
# A pair at the threshold lies this far below it in agreeing slots, 6.5 standard deviations of the plain estimator (SuperMinHash has less).
DEVIATIONS = 6.5
TRACED = 4
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the splitmix64 generator, on 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; fewer
    words than ``width`` make one shingle of the whole sequence; no words, none.
    """
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(width, len(h))
    out = np.full(len(h) - take + 1, take, np.uint64)
    for k in range(take):
        out = out * _MUL + h[k : len(h) - take + 1 + k]
    return np.unique(_mix(out))


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """A row of ``slots`` 64-bit signature values for each non-empty set.

    Round j gives every element its j-th place in a random permutation of the slots, drawn
    from the element's own generator, and a value in [j, j + 1): the integer part is held in
    the high half, the fraction in the low.  A slot keeps the least value that falls to it.
    A set whose slots are all taken after round j can get no lesser values and stops.
    """
    sizes = [len(s) for s in sets]
    seed = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    empty = np.uint64(2**64 - 1)
    sig = np.full(len(sets) * slots, empty, np.uint64)
    swaps: list[np.ndarray] = []  # of the first rounds: where round t's swap went
    perm = None
    for j in range(slots):
        drawn = _mix(seed + np.uint64((j + 1) * int(_MUL) & 2**64 - 1))
        k = (np.uint64(j) + ((drawn >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32))).astype(np.int64)
        if j < TRACED:  # trace position k back through the swaps instead of holding permutations
            slot = k.copy()
            for t in reversed(range(j)):
                slot[slot == swaps[t]] = t
            swaps.append(k)
        else:
            at = np.arange(len(seed))
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint16), (len(seed), 1))
                for t, to in enumerate(swaps):
                    perm[at, to], perm[:, t] = perm[:, t].copy(), perm[at, to]
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(sig, row * slots + slot, (np.uint64(j) << np.uint64(32)) | (drawn & np.uint64(0xFFFFFFFF)))
        more = (sig.reshape(-1, slots) == empty).any(axis=1)[row]
        left = int(more.sum())
        if not left:
            break
        if left < 0.8 * len(more):
            seed, row = seed[more], row[more]
            swaps = [t[more] for t in swaps] if perm is None else swaps
            perm = None if perm is None else perm[more]
    return sig.reshape(-1, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands))
    for k in range(rows):
        key = key * _MUL + _mix(parts[:, :, k])
    return _mix(key).view(np.int64)


def identity_of(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The identity of a set, 128 bits of a hash of its sorted members, as two whole numbers; only ``bits`` of the first are used."""
    first, second = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), "<i8").tolist()
    return first >> (64 - bits), second


def sketch(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS, tag: Column | None = None, identity_bits: int = 64) -> DataFrame:
    """doc_id, tag, said (a hash of the text), n_shingles, vertex and proof (identity of the shingle set; null for an empty one), keys (one a band), sig (16 bits a slot)."""
    schema = "doc_id long, tag long, said long, n_shingles long, vertex long, proof long, keys array<long>, sig binary"
    slots = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                with without_collector():
                    sets = [shingle_set(t, width) for t in part.column(3).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = superminhash([sets[i] for i in full], slots)
                keys, low = band_keys(sig, bands, rows), (_mix(sig) & np.uint64(0xFFFF)).astype("<u2")
                own_keys: list = [None] * len(sets)
                own_sig: list = [None] * len(sets)
                vertex: list = [None] * len(sets)
                proof: list = [None] * len(sets)
                for n, i in enumerate(full):
                    own_keys[i], own_sig[i] = keys[n], low[n].tobytes()
                    vertex[i], proof[i] = identity_of(sets[i], identity_bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(vertex, pa.int64()), pa.array(proof, pa.int64()), pa.array(own_keys, pa.list_(pa.int64())), pa.array(own_sig, pa.binary())],
                    names=["doc_id", "tag", "said", "n_shingles", "vertex", "proof", "keys", "sig"],
                )

    tag = F.lit(None) if tag is None else tag
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.cast("long").alias("tag"), F.xxhash64(text).alias("said"), text.alias("text")).mapInArrow(run, schema)


def _told_apart(own: DataFrame, scratch: Scratch) -> DataFrame:
    """Vertices that stand for several sets get the rest of the identity mixed in; at 64 bits next to none do."""
    proofs = own.filter("vertex is not null").groupBy("vertex").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi"))
    shared = scratch.cut(proofs.filter("lo <> hi").select("vertex", F.lit(True).alias("shared")), "shared")
    if not shared.limit(1).count():
        return own
    names = own.columns
    mixed = F.when(F.col("shared"), F.xxhash64("vertex", "proof")).otherwise(F.col("vertex")).alias("vertex")
    return scratch.cut(own.join(shared, "vertex", "left").select(*[mixed if c == "vertex" else c for c in names]), "told-apart")


def _full_sets(texts: DataFrame, width: int) -> DataFrame:
    """vertex, members (the full shingle set) of each row whose text has this set; of rows of one vertex in a row, the first alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                vertex = part.column(0).to_pylist()
                new = [v != w for v, w in zip(vertex, [before, *vertex], strict=False)]
                before = vertex[-1]
                part = part.filter(pa.array(new, pa.bool_()))
                with without_collector():
                    sets = [shingle_set(t, width).view(np.int64) for t in part.column(2).to_pylist()]
                own = [p == identity_of(s)[1] for p, s in zip(part.column(1).to_pylist(), sets, strict=True)]
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["vertex", "members"])
                yield rows.filter(pa.array(own, pa.bool_()))

    return texts.select("vertex", "proof", "text").mapInArrow(run, "vertex long, members array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("vertex").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("vertex").alias("b"), F.col("members").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").filter(100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _find(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = parent[x]
    return x


def _joined(rows: pa.Table, slots: int, percent: int, exact: bool) -> list[tuple[int, int]]:
    """Links that join the roots of one block's left and right rows, each to the smallest of those it is joined with.

    A pair counts if its sizes and signatures allow the threshold and, if ``exact``, its full
    sets reach it.  Pairs whose roots the forest already joins are passed over.
    """
    p = percent / 100
    least = slots * p - DEVIATIONS * (slots * p * (1 - p)) ** 0.5
    right_side = rows["side"].to_numpy() == 1
    vertex, n, root = (rows[c].to_numpy() for c in ("vertex", "n_shingles", "root"))
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u2").reshape(-1, slots)
    main = rows["main"].to_numpy(zero_copy_only=False)
    sets: dict[int, frozenset] = {}

    def members(i: int) -> frozenset:
        if i not in sets:
            sets[i] = frozenset(rows["members"][i].as_py())
        return sets[i]

    parent: dict[int, int] = {}
    right = np.flatnonzero(right_side)
    for x in np.flatnonzero(~right_side).tolist():
        # Of two rows outside the main component, the smaller is the left one, once.
        y = right[(root[right] != root[x]) & (main[right] | (vertex[right] > vertex[x]))]
        y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
        same = (sig[y] == sig[x]).sum(axis=1)
        order = np.argsort(-same, kind="stable")
        for k in order[: int((same >= least).sum())].tolist():
            i = int(y[k])
            a, b = _find(parent, int(root[x])), _find(parent, int(root[i]))
            if a == b:
                continue
            if exact:
                shared = len(members(x) & members(i))
                if 100 * shared < percent * (int(n[x]) + int(n[i]) - shared):
                    continue
            parent[max(a, b)] = min(a, b)
    return [(r, _find(parent, r)) for r in parent if _find(parent, r) != r]


def _forests(placed: DataFrame, group: str, slots: int, percent: int, scratch: Scratch, faces: DataFrame, exact: bool) -> DataFrame:
    """Links (a, b) between roots of the same group.

    ``placed``: the group column, vertex, root.  The root with most of a group's rows is its
    main one; its rows are compared with the others', not with one another.  A group is dealt
    out in blocks of about BLOCK left rows (outside the main root) and BLOCK right ones (all).
    """
    shares = placed.groupBy(group, "root").agg(F.count("*").alias("n"))
    mixed = shares.groupBy(group).agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.count("*").alias("n_roots"))
    mixed = mixed.filter("n_roots > 1").select(group, F.col("main.root").alias("main_root"), F.ceil((F.col("total") - F.col("main.n")) / BLOCK).cast("int").alias("n_left"), F.ceil(F.col("total") / BLOCK).cast("int").alias("n_right"))
    mixed = scratch.cut(mixed, f"mixed-{group}")
    rest = scratch.cut(placed.join(mixed, group), f"rest-{group}").join(faces, "vertex")
    rest = rest.withColumn("main", F.col("root") == F.col("main_root"))
    spread = F.xxhash64("vertex")
    right = rest.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"), F.pmod(spread, F.col("n_right")).cast("int").alias("j"))
    left = rest.filter("not main").select("*", F.lit(0).alias("side"), F.pmod(spread, F.col("n_left")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("j"))
    names = [group, "i", "j", "side", "vertex", "root", "main", "n_shingles", "sig", *["members"] * exact]
    blocks = left.select(names).unionByName(right.select(names)).repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def runs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
            ident = np.stack([table[c].to_numpy() for c in (group, "i", "j")])
            cuts = [0, *(np.flatnonzero((ident[:, 1:] != ident[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            whole = cuts if last else cuts[:-1]
            with without_collector():
                found = [link for a, b in zip(whole, whole[1:], strict=False) for link in _joined(table.slice(a, b - a), slots, percent, exact)]
            links = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(links, names=["a", "b"]), table.slice(whole[-1]).to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BLOCK):
                done, kept = runs(pa.Table.from_batches([*kept, batch.slice(at, 4 * BLOCK)]), False)
                yield done
        if kept:
            yield runs(pa.Table.from_batches(kept), True)[0]

    return scratch.cut(blocks.mapInArrow(run, "a long, b long"), f"forest-{group}")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, tag: Column | None = None, identity_bits: int = 64) -> DataFrame:
    """Groups documents whose word-shingle sets have 100 * intersection >= percent * union, and chains of such.

    Returns, for each row: doc_id, n_shingles (size of its set), component_id (the smallest
    doc_id reachable, itself included) and kept (doc_id = component_id); with ``tag``, a column
    made of the documents' own, also vertex (which set it is) and tag.

    A text without words, or null, has an empty set, is linked with nothing and is kept; so
    is a row whose doc_id is null (its component_id is null).  Repeated rows are copies of
    one another and each gets a row; rows of one id with different texts are documents of
    their own.  An empty table gives an empty result.  Other columns, whatever their names, are
    ignored.  Sets are compared as sets of 64-bit hashes, and equal if 128 bits of a hash are.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    slots = bands * rows
    own = _told_apart(scratch.cut(sketch(docs, width, bands, rows, tag, identity_bits), "sketch"), scratch)
    linked = own.filter("vertex is not null and doc_id is not null")

    # Buckets with two vertices or more; copies of one set count once.
    entries = linked.select(F.explode("keys").alias("key"), "vertex")
    buckets = scratch.cut(entries.groupBy("key").agg(F.min("vertex").alias("hub"), F.max("vertex").alias("top")).filter("hub != top").select("key", "hub"), "buckets")
    members = scratch.cut(entries.join(buckets, "key").groupBy("vertex", "key", "hub").agg(F.lit(1).alias("one")).drop("one"), "members")

    # Full sets of the vertices that share a bucket, from one text each.
    active = members.select("vertex").distinct()
    first = linked.groupBy("vertex").agg(F.min(F.struct("doc_id", "said")).alias("x"), F.min("proof").alias("proof"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    one = scratch.cut(first.join(active, "vertex").select("vertex", "x.*", "proof", "n_shingles", "sig"), "active")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("said", F.xxhash64("text"))
    # By id and text, so that rows of one id meet their own set alone; a merge join at every size, which brings rows that repeat one after another.
    sets = scratch.cut(_full_sets(texts.join(one.select("doc_id", "said", "vertex", "proof").hint("merge"), ["doc_id", "said"]), width), "sets")

    # Each vertex against its smallest hub.
    to_hub = members.groupBy(F.col("vertex").alias("a")).agg(F.min("hub").alias("b")).filter("a != b")
    roots = components(scratch.cut(_verified(to_hub, sets, percent), "links-hub"), scratch, "hubs")

    # Buckets whose vertices lie in different components still: clusters of what agrees by signature.
    placed = scratch.cut(members.select("vertex", "key").join(roots, members.vertex == roots.node, "left").select("key", "vertex", F.coalesce("root", "vertex").alias("root")), "placed")
    faces = one.select("vertex", "n_shingles", "sig")
    clusters = components(_forests(placed, "key", slots, percent, scratch, faces, False), scratch, "clusters")

    # A cluster's components, on full sets.
    near = placed.select("vertex", "root").distinct().join(clusters.select(F.col("node").alias("root"), F.col("root").alias("cluster")), "root")
    near = scratch.cut(near.select("cluster", "vertex", "root"), "near")
    tops = components(_forests(near, "cluster", slots, percent, scratch, faces.join(sets, "vertex"), True), scratch, "tops")
    scratch.drop("sets", "active", "placed", "members", "buckets", "near")

    tops = tops.select(F.col("node").alias("at"), F.col("root").alias("top"))
    first_roots = roots.join(tops, roots.root == tops["at"], "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = tops.join(roots, tops["at"] == roots.node, "left_anti").select(F.col("at").alias("node"), F.col("top").alias("root"))
    final = scratch.cut(first_roots.union(alone), "final")

    extra = ["vertex", "tag"] if tag is not None else []
    mine = own.select("doc_id", "n_shingles", "vertex", "tag")
    ends = scratch.cut(mine.join(final, mine.vertex == final.node, "left").select("doc_id", "n_shingles", F.coalesce("root", "vertex").alias("root"), *extra), "ends")
    least = scratch.cut(ends.filter("root is not null and doc_id is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    out = ends.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNotNull() & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *extra)
