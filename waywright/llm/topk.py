"""Exact top-k search by inner product: a Voronoi kNN join.

Queries and data are grouped by their nearest pivot.  A cell of queries is summed up by its
mean, its radius and the least score that its queries are sure of; a cell of data by its
pivot, its radius and its greatest norm.  Cells of data that can't reach a query cell's sure
score are ruled out by these summaries alone, vectors of the others by a bound of their own,
and only what is left is replicated.  Neighbouring query cells form the groups that data are
replicated to.  In a group, queries meet their data in a stream and keep a running top k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Pivots, at most, and vectors a pivot, about.  Twice the most pivots are sampled rows, which also give the scores that queries are sure of.
PIVOTS, A_PIVOT = 512, 64
#: Queries of a group (and of a block, where one cell has more), and the sizes of data blocks: what one task holds and streams.
QUERY_BLOCK, LEAST_BLOCK, MOST_BLOCK = 16_384, 8_192, 1 << 20
#: Queries and data that are multiplied at a time.
TILE_QUERIES, TILE_DATA = 1_024, 2_048
UNPLACED = -1
SLACK = 1e-6


def usable(vector: str) -> Column:
    """Not null, and every component a finite number."""
    c = F.col(vector)
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantized(vector: str) -> Column:
    """floor(256 * x) of each component, as a double; the product by a power of two is exact."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * 256).cast("double"))


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, counted: bool = False, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best-scoring other rows of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates, all rows with another
    id.  A query row that is repeated with the same vector is one query; rows of one id with
    different vectors are a query each, with ranks of its own.  Scores are integer inner
    products of floor(256 * x), ties going to the smaller id; fewer candidates give fewer rows.
    Rows with a null id, a null vector, or a null or non-finite component take no part; vectors
    are scored against others of their own length only.  Candidates with repeated ids are
    separate.  Other columns, whatever their names, are ignored.  An empty table gives no rows.
    Scores are exact while components and sums stay below 2^53.

    With ``counted``, a column ``scored`` says how many candidates were multiplied with the query.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    clean = vectors.filter(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), quantized(vector).alias("v"))
    clean = scratch.cut(clean.withColumn("dim", F.size("v")), "vectors")
    # Pivots are a hash-ordered sample of a bounded size; of the rows' lengths, those that the sample misses go without pivots.
    total = clean.count()
    wanted = min(pivots, max(2, total // A_PIVOT))
    drawn = clean.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(2 * pivots).collect()
    samples: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    centres: dict[int, np.ndarray] = {}
    first: dict[int, int] = {}  # of a length's pivots
    for dim in sorted({r.dim for r in drawn}):
        own = [r for r in drawn if r.dim == dim]
        samples[dim] = np.array([r.vec_id for r in own]), np.array([r.v for r in own], float).reshape(len(own), dim)
        chosen = list({tuple(r.v): r.v for r in own}.values())
        first[dim] = sum(len(c) for c in centres.values())
        chosen = chosen[: max(1, min(wanted, len(chosen) // 2))]
        centres[dim] = np.array(chosen, float).reshape(len(chosen), dim)
    shared = spark.sparkContext.broadcast((samples, centres, first))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's cell, its distance from the pivot, its norm and, for a query, the k-th best score that it is sure of: among the sampled rows, its own id left out."""
        samples, centres, first = shared.value
        for batch in (b.slice(at, TILE_DATA) for b in batches for at in range(0, b.num_rows, TILE_DATA)):
            ids, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cell, far, norm = np.full(len(ids), UNPLACED, np.int32), np.zeros(len(ids)), np.zeros(len(ids))
            sure = np.full(len(ids), -np.inf)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _rows(batch.column(1).take(pa.array(at)))
                norm[at] = np.sqrt((x**2).sum(1))
                if dim in centres:
                    gap = (centres[dim] ** 2).sum(1)[None] - 2 * x @ centres[dim].T
                    near = gap.argmin(1)
                    cell[at] = first[dim] + near
                    far[at] = np.sqrt(((x - centres[dim][near]) ** 2).sum(1))
                    asked = np.flatnonzero(ids[at] % every == 0)
                    own, sample = samples[dim]
                    if len(own) >= k and len(asked):
                        scores = np.where(own[None] == ids[at][asked][:, None], -np.inf, x[asked] @ sample.T)
                        sure[at[asked]] = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(norm), pa.array(sure)], names=["vec_id", "v", "dim", "cell", "far", "norm", "sure"])

    placed = scratch.cut(clean.mapInArrow(assign, "vec_id long, v array<double>, dim int, cell int, far double, norm double, sure double"), "placed")
    asking = placed.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumn("which", F.xxhash64("v"))
    asking = scratch.cut(asking.select("vec_id", "which", "v", "dim", "cell", "far", "sure"), "asking")

    # Summaries: a row a cell, so that their number is bounded by the pivots'.
    of_data = {r.cell: r for r in placed.filter(F.col("cell") >= 0).groupBy("cell").agg(F.max("far").alias("far"), F.max("norm").alias("norm")).collect()}
    of_queries = {r.cell: r for r in asking.filter(F.col("cell") >= 0).groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("sure").alias("sure")).collect()}
    plans = {dim: Plan(dim, c, first[dim], of_data, of_queries, query_block) for dim, c in centres.items()}
    block = max(LEAST_BLOCK, min(MOST_BLOCK, total // 64))
    blocks = max(1, -(-total // block))
    bounds = spark.sparkContext.broadcast(plans)
    # Lengths without pivots, and cells beyond a block of queries, are cut by a hash of the query.
    crowd = {r.dim: max(1, -(-r.n // query_block)) for r in asking.filter(F.col("cell") == UNPLACED).groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > query_block).collect()}

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A data vector for each query group in which it could reach a sure score, once for each of its blocks of queries."""
        plans, n = bounds.value, 0
        for batch in (b.slice(at, TILE_DATA) for b in batches for at in range(0, b.num_rows, TILE_DATA)):
            dims, cells, norm = (batch.column(i).to_numpy() for i in (2, 3, 4))
            if not n:  # blocks are dealt in turn, so that repeated ids don't share one
                n = int(batch.column(0)[0].as_py()) % blocks
            out_row, out_group, out_part = [], [], []
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in plans:
                    row, group, part = np.repeat(at, crowd.get(dim, 1)), np.full(len(at) * crowd.get(dim, 1), 0), np.tile(np.arange(crowd.get(dim, 1)), len(at))
                else:
                    p = plans[dim]
                    x = _rows(batch.column(1).take(pa.array(at)))
                    reach = p.reached(x, norm[at], cells[at])
                    row, group = np.nonzero(reach)
                    times = p.blocks[group]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, group = at[np.repeat(row, times)], np.repeat(group, times)
                out_row.append(row)
                out_group.append(group)
                out_part.append(part)
            row, group, part = (np.concatenate(c) for c in (out_row, out_group, out_part))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(group.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array((((n + row) % blocks)).astype(np.int32))],
                names=["vec_id", "v", "dim", "cell", "group", "part", "block"],
            )
            n += batch.num_rows

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's group, and its block of queries there."""
        plans = bounds.value
        for batch in batches:
            dims, cells, which = (batch.column(i).to_numpy() for i in (3, 4, 1))
            mix = (batch.column(0).to_numpy() * 0x9E3779B1 ^ which) >> 13
            group, part = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in plans:
                    group[at] = plans[dim].group_of[cells[at] - plans[dim].first]
                    part[at] = mix[at] % plans[dim].blocks[group[at]]
                else:
                    part[at] = mix[at] % crowd.get(dim, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(part)], names=["vec_id", "which", "v", "dim", "cell", "sure", "group", "part"])

    tile = ["dim", "group", "part", "block"]
    data = placed.select("vec_id", "v", "dim", "cell", "norm").mapInArrow(replicate, "vec_id long, v array<double>, dim int, cell int, group int, part int, block int")
    asked = asking.select("vec_id", "which", "v", "dim", "cell", "sure").mapInArrow(home, "vec_id long, which long, v array<double>, dim int, cell int, sure double, group int, part int")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    nothing = lambda t: F.lit(None).cast(t)
    names = [*tile, "side", "cell", "vec_id", "which", "sure", "v"]
    both = asked.withColumn("side", F.lit(0)).select(names).unionByName(data.withColumns({"side": F.lit(1), "which": nothing("long"), "sure": nothing("double")}).select(names))
    met = both.repartition(*tile).sortWithinPartitions(*tile, "side", "cell")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles in turn: their queries first, then their data, of which each query keeps the k best so far."""
        now, held = None, None
        for batch in (b.slice(at, TILE_DATA) for b in batches for at in range(0, b.num_rows, TILE_DATA)):
            ident = np.stack([batch.column(i).to_numpy() for i in range(5)])
            cuts = [0, *(np.flatnonzero((ident[:, 1:] != ident[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key, part = tuple(ident[:4, a].tolist()), batch.slice(a, b - a)
                if key != now:
                    if held:
                        yield from held.results()
                    now, held = key, None
                if ident[4, a] == 0:
                    held = held or Asked(k)
                    held.add(part)
                elif held:
                    held.see(part.column(6).to_numpy(), _rows(part.column(9)))
        if held:
            yield from held.results()

    found = met.mapInArrow(meet, "query_id long, which long, vec_id long, score long, scored long")
    best = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    if counted:
        scored = scratch.cut(found, "found")
        counts = scored.select("query_id", "which", "scored").groupBy("query_id", "which").agg(F.sum("scored").alias("scored"))
        found = scored.drop("scored").join(counts, ["query_id", "which"])
    ranked = found.filter("vec_id is not null").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *["scored"] * counted)
    return scratch.cut(out, "best")


class Plan:
    """Of one vector length: its query cells with their bounds, which data cells each could need, and the groups of query cells."""

    def __init__(self, dim: int, centres: np.ndarray, first: int, of_data: dict, of_queries: dict, query_block: int):
        self.first = first
        n = len(centres)
        used = [c for c in range(n) if first + c in of_queries]
        own = [of_queries[first + c] for c in used]
        self.middle, self.radius, self.sure = centres[used], np.array([r.far for r in own]), np.array([r.sure for r in own])
        self.sure = self.sure - SLACK * (1 + np.abs(self.sure))
        # q.x <= c.p + r|p| + |c|s + rs for |q - c| <= r, |x - p| <= s, and no more than (|c| + r) times the cell's greatest norm.
        size, reach = np.sqrt((centres**2).sum(1)), np.sqrt((self.middle**2).sum(1))
        there = [of_data.get(first + c) for c in range(n)]
        spread, norm = (np.array([getattr(r, name) if r else 0.0 for r in there]) for name in ("far", "norm"))
        most = self.middle @ centres.T + self.radius[:, None] * size[None] + (reach + self.radius)[:, None] * spread[None]
        self.open = np.minimum(most, (reach + self.radius)[:, None] * norm[None]) >= self.sure[:, None]
        # Groups: a walk from each cell to the nearest one left, cut where a block of queries is full.
        left, order = set(range(len(used))), []
        while left:
            at = min(left, key=lambda i: (((self.middle[i] - self.middle[order[-1]]) ** 2).sum() if order else 0.0, i))
            left.discard(at)
            order.append(at)
        self.group, counts = np.zeros(len(used), np.int64), [0] if used else []
        for i in order:
            if counts[-1] and counts[-1] + own[i].n > query_block:
                counts.append(0)
            counts[-1] += own[i].n
            self.group[i] = len(counts) - 1
        self.blocks = np.array([max(1, -(-c // query_block)) for c in counts], np.int64)
        self.group_of = np.zeros(n, np.int32)
        self.group_of[used] = self.group

    def reached(self, x: np.ndarray, norm: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each vector and group, whether a query there might need it."""
        out = np.zeros((len(x), len(self.blocks)), bool)
        if len(self.blocks):
            open_ = self.open[:, cells - self.first].T
            open_ &= x @ self.middle.T + norm[:, None] * self.radius[None] >= self.sure[None]
            row, cell = np.nonzero(open_)
            out[row, self.group[cell]] = True
        return out


class Asked:
    """The queries of one tile with their k best so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.ready = k, [], False

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def _begin(self) -> None:
        rows = pa.Table.from_batches(self.parts)
        self.ids, self.which, self.cell = (rows[c].to_numpy() for c in ("vec_id", "which", "cell"))
        self.x = _rows(rows["v"].combine_chunks())
        self.least = rows["sure"].to_numpy().copy()  # a score below it is no use
        self.score, self.other = np.full((len(self.ids), self.k), -np.inf), np.full((len(self.ids), self.k), -1, np.int64)
        self.scored = np.zeros(len(self.ids), np.int64)
        cuts = [0, *(np.flatnonzero(self.cell[1:] != self.cell[:-1]) + 1).tolist(), len(self.cell)]
        self.spans = list(zip(cuts, cuts[1:], strict=False))
        self.middle = np.stack([self.x[a:b].mean(axis=0) for a, b in self.spans])
        self.radius = np.array([np.sqrt(((self.x[a:b] - m) ** 2).sum(1)).max() for (a, b), m in zip(self.spans, self.middle, strict=True)])
        self.parts, self.ready = [], True

    def see(self, ids: np.ndarray, y: np.ndarray) -> None:
        if not self.ready:
            self._begin()
        floor = np.array([self.least[a:b].min() for a, b in self.spans])
        use = self.middle @ y.T + self.radius[:, None] * np.sqrt((y**2).sum(1))[None] >= (floor - SLACK * (1 + np.abs(floor)))[:, None]
        rows = np.flatnonzero(use.any(axis=0))
        if not len(rows):
            return
        ids, y, use = ids[rows], y[rows], use[:, rows]
        queries = np.concatenate([np.arange(a, b) for (a, b), u in zip(self.spans, use, strict=True) if u.any()])
        for at in range(0, len(queries), TILE_QUERIES):
            q = queries[at : at + TILE_QUERIES]
            s = self.x[q] @ y.T
            self.scored[q] += len(y)
            i, j = np.nonzero(s >= self.least[q][:, None])
            other = ids[j] != self.ids[q[i]]
            self._keep(q[i[other]], s[i[other], j[other]], ids[j[other]])

    def _keep(self, query: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, self.k)])
        score, other = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([other, self.other[touched].ravel()])
        order = np.lexsort((other, -score, query))
        query, score, other = query[order], score[order], other[order]
        start = np.searchsorted(query, touched)
        best = start[:, None] + np.arange(self.k)[None]
        self.score[touched], self.other[touched] = score[best], other[best]
        self.least[touched] = np.maximum(self.least[touched], self.score[touched, -1])

    def results(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            return
        q, n = np.nonzero(np.isfinite(self.score))
        none = np.setdiff1d(np.arange(len(self.ids)), q)
        query = np.concatenate([q, none])
        firsts = np.concatenate([n == 0, np.ones(len(none), bool)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[query]), pa.array(self.which[query]), pa.array(np.concatenate([self.other[q, n], np.zeros(len(none), np.int64)]), mask=np.arange(len(query)) >= len(q)),
                pa.array(np.concatenate([self.score[q, n], np.zeros(len(none))]).astype(np.int64)), pa.array(np.where(firsts, self.scored[query], 0)),
            ],
            names=["query_id", "which", "vec_id", "score", "scored"],
        )
