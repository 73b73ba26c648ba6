"""Exact top-k search by inner product with two cover trees at a time.

1. Equal vectors become one class with its smallest ids: more of them than are asked
   for can't be in a result, however many rows repeat a vector.
2. The upper levels of the index are cells around spread-out vectors of a bounded
   sample.  Classes are range-partitioned by cell, so a large cell is many tasks, and
   packed to blocks.  A block has a cover tree of its vectors and one of its queries.
3. A block's queries search their own block first.  The scores that this finds are
   floors: a cell whose bound is below the worst floor of a block's queries is not
   visited by them.
4. The queries of a block meet the blocks of the cells that are left, in a join by cell.
   A search descends both trees together, best bound first, and leaves a pair of nodes
   out when no vector of the one can reach the worst kth score of the other's queries.

With ``q`` and ``p`` within radii ``r`` and ``s`` of centers ``a`` and ``b``, an inner product is at
most ``<a, b> + r |b| + s |a| + r s``.  Bounds are floating-point numbers with a margin above
their error; scores are whole numbers, multiplied exactly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondera.llm import textkit
from pondera.plans.scratch import Scratch, spread

#: Vectors of a leaf, and most children of a node.
LEAF, FAN = 32, 64
NONE, NO_ID = -(2**63 - 1), 2**63 - 1
#: Bytes of the sample that the cells are fitted on.
SAMPLE_BYTES = 32 << 20


def spread_out(x: np.ndarray, first: int, most: int, radius: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first centers until all rows are within the radius of one, each row's center, and the squared distances."""
    centers, owner = [first], np.zeros(len(x), np.int64)
    near = ((x - x[first]) ** 2).sum(1)
    while len(centers) < most and near.max() > radius * radius:
        centers.append(int(near.argmax()))
        far = ((x - x[centers[-1]]) ** 2).sum(1)
        closer = far < near
        owner[closer] = len(centers) - 1
        near = np.minimum(near, far)
    return centers, owner, near


def _parts(sizes: np.ndarray, heads: list[int], center: int) -> tuple[np.ndarray, list[int]]:
    """Each child's part and the parts' centers: small children share leaves around their parent's center."""
    part, middles, leaf, held = np.empty(len(sizes), np.int64), [], -1, LEAF
    for k, n in enumerate(sizes.tolist()):
        if n >= LEAF // 4:
            part[k] = len(middles)
            middles.append(heads[k])
            continue
        if held + n > LEAF:
            leaf, held = len(middles), 0
            middles.append(center)
        part[k], held = leaf, held + n
    return part, middles


class CoverTree:
    """Nested balls: a node's children have centers at least half its radius apart that cover it.

    ``points`` are in tree order, so a node has the rows ``lo`` to ``hi``; its children are the
    nodes ``first`` to ``last`` (none in a leaf).  A node that needs over ``FAN`` children for half
    its radius has larger ones, and children of a few vectors share leaves; radii are
    measured, so bounds hold all the same.
    """

    def __init__(self, points: np.ndarray):
        x = points.astype(np.float64)
        order = np.arange(len(x))
        center = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
        lo, hi, first, last, radius, i = [0], [len(x)], [0], [0], [0.0], 0
        while i < len(lo):
            rows = order[lo[i] : hi[i]]
            own = x[rows]
            from_center = ((own - x[center[i]]) ** 2).sum(1)
            radius[i] = float(np.sqrt(from_center.max()))
            first[i] = last[i] = len(lo)
            if len(rows) > LEAF and radius[i] > 0:
                heads, owner, _ = spread_out(own, int(from_center.argmin()), FAN, radius[i] / 2)
                part, middles = _parts(np.bincount(owner), rows[heads].tolist(), center[i])
                owner = part[owner]
                by = np.argsort(owner, kind="stable")
                order[lo[i] : hi[i]] = rows[by]
                cuts = lo[i] + np.searchsorted(owner[by], np.arange(len(middles) + 1))
                lo += cuts[:-1].tolist()
                hi += cuts[1:].tolist()
                center += middles
                first += [0] * len(middles)
                last += [0] * len(middles)
                radius += [0.0] * len(middles)
                last[i] = len(lo)
            i += 1
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        self.order, self.center, self.radius = order, place[center], np.array(radius)
        self.lo, self.hi, self.first, self.last = (np.array(v, np.int64) for v in (lo, hi, first, last))
        self._fill(points[order])

    def _fill(self, points: np.ndarray) -> None:
        self.points = points.astype(np.float64)
        self.norms = np.sqrt((self.points**2).sum(1))
        self.exact = None if (self.norms.max() if len(points) else 0) < 2**26 else points.astype(np.int64)
        self.heads = self.points[self.center]
        self.head_norms = self.norms[self.center]

    def __getstate__(self) -> dict:
        whole = self.exact if self.exact is not None else self.points.astype(np.int64)
        top = int(np.abs(whole).max()) if whole.size else 0
        small = next(k for k in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
        return {k: getattr(self, k) for k in ("order", "center", "radius", "lo", "hi", "first", "last")} | {"points": whole.astype(small)}

    def __setstate__(self, state: dict) -> None:
        points = state.pop("points")
        self.__dict__.update(state)
        self._fill(points)

    def products(self, i: int, other: CoverTree, j: int) -> np.ndarray:
        """Inner products of all vectors of two nodes."""
        a, b = slice(self.lo[i], self.hi[i]), slice(other.lo[j], other.hi[j])
        if self.exact is None and other.exact is None:
            return (self.points[a] @ other.points[b].T).astype(np.int64)  # below 2^52 in any order of sums
        whole = [t.points.astype(np.int64) if t.exact is None else t.exact for t in (self, other)]
        return whole[0][a] @ whole[1][b].T


def bounds(a: np.ndarray, a_norm: np.ndarray, r: np.ndarray, b: np.ndarray, b_norm: np.ndarray, s: np.ndarray) -> np.ndarray:
    """No inner product of the balls of one center with those of others is above this."""
    reach = (a_norm + r) * (b_norm + s)
    return np.minimum(b @ a + r * b_norm + s * a_norm + r * s, reach) + 1e-9 * reach + 0.5


class Best:
    """The best ``k`` scores so far of a tree's queries, and the floors that a new one must reach."""

    def __init__(self, queries: CoverTree, k: int, floor: np.ndarray | None = None):
        self.queries, self.k = queries, k
        n = len(queries.points)
        self.scores, self.ids = np.full((n, k), NONE), np.full((n, k), NO_ID)
        self.floor = np.full(n, NONE) if floor is None else floor.copy()

    def search(self, data: CoverTree, ids: np.ndarray) -> None:
        """Meet the vectors of another tree; ``ids`` are in its order."""
        q, d = self.queries, data
        stack = [(0, 0, float("inf"))]
        while stack:
            i, j, most = stack.pop()
            if most < self.floor[q.lo[i] : q.hi[i]].min():
                continue
            a, b, c, e = q.first[i], q.last[i], d.first[j], d.last[j]
            if a == b and c == e:
                self._meet(i, j, data, ids)
            elif c == e or a < b and q.radius[i] >= d.radius[j]:
                found = bounds(d.heads[j], d.head_norms[j], d.radius[j], q.heads[a:b], q.head_norms[a:b], q.radius[a:b])
                stack += [(int(a + x), j, float(found[x])) for x in np.argsort(found, kind="stable")]
            else:
                found = bounds(q.heads[i], q.head_norms[i], q.radius[i], d.heads[c:e], d.head_norms[c:e], d.radius[c:e])
                stack += [(i, int(c + x), float(found[x])) for x in np.argsort(found, kind="stable")]

    def _meet(self, i: int, j: int, data: CoverTree, ids: np.ndarray) -> None:
        found, own = self.queries.products(i, data, j), ids[data.lo[j] : data.hi[j]]
        base = self.queries.lo[i]
        good = found >= self.floor[base : self.queries.hi[i], None]
        for row in np.flatnonzero(good.any(1)).tolist():
            at = base + row
            s = np.concatenate([self.scores[at], found[row, good[row]]])
            v = np.concatenate([self.ids[at], own[good[row]]])
            top = np.lexsort((v, -s))[: self.k]
            self.scores[at], self.ids[at] = s[top], v[top]
            self.floor[at] = max(self.floor[at], self.scores[at, -1])

    def rows(self, uids: np.ndarray) -> pa.RecordBatch:
        """``uid, score, id`` of what was found; ``uids`` are in the queries' tree order."""
        full = self.scores > NONE
        row = np.nonzero(full)[0]
        return pa.RecordBatch.from_arrays([pa.array(uids[row]), pa.array(self.scores[full]), pa.array(self.ids[full])], ["uid", "score", "id"])


def whole_vectors(embedding: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of each component as a double; null unless all components are finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column and the rows' borders in them."""
    borders = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[borders[0] : borders[-1]], borders - borders[0]


def fit_cells(classes: DataFrame, block: int, cells: int, sample: int) -> dict[int, np.ndarray]:
    """Cell centers for the commonest lengths of vectors, from at most ``sample`` vectors or ``SAMPLE_BYTES``."""
    n, longest = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    most = max(1, min(sample, SAMPLE_BYTES // (8 * max(longest or 1, 1))))
    rows = classes.orderBy(F.xxhash64("v")).limit(most).select("v").toArrow().column(0).to_pylist() if n else []
    by: dict[int, list[list[int]]] = {}
    for v in rows:
        by.setdefault(len(v), []).append(v)
    left, out = min(cells, -(-n // block)), {}
    for dim, group in sorted(by.items(), key=lambda e: -len(e[1])):
        if left > 0 and dim:
            x = np.array(group, np.float64)
            out[dim] = x[spread_out(x, 0, max(1, left * len(group) // len(rows)))[0]]
            left -= len(out[dim])
    return out


def _assign(centers: dict[int, np.ndarray]):
    """Add each class's cell: the nearest center's number, or -1 for a length without centers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, borders = _matrix(batch.column("v"))
            cell, dims = np.full(batch.num_rows, -1, np.int32), np.diff(borders)
            for dim in np.unique(dims).tolist():
                if dim in centers:
                    rows = np.flatnonzero(dims == dim)
                    x = values[borders[rows][:, None] + np.arange(dim)].astype(np.float64)
                    c = centers[dim]
                    cell[rows] = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


_BLOCK = "block bigint, dim int, cell int, reach double, data binary, asks binary, own array<struct<uid:bigint,score:bigint,id:bigint>>"


def _blocks(centers: dict[int, np.ndarray], block: int, k: int):
    """Blocks of the sorted classes of a partition, with the results of each block's queries in it."""

    def pack(dim: int, cell: int, rows: list[tuple], number: int) -> pa.RecordBatch:
        x = np.array([r[1] for r in rows], np.int64).reshape(len(rows), dim)
        counts = [len(r[2]) for r in rows]
        ids = np.array([i for r in rows for i in r[2]], np.int64)
        tree = CoverTree(np.repeat(x, counts, 0))
        ids = ids[tree.order]
        asked = [n for n, r in enumerate(rows) if r[3]]
        reach = float(np.sqrt(((x - centers[dim][cell]) ** 2).sum(1).max())) if cell >= 0 else 0.0
        asks, own = None, []
        if asked:
            queries = CoverTree(x[asked])
            best = Best(queries, k)
            best.search(tree, ids)
            uids = np.array([rows[asked[n]][0] for n in queries.order], np.int64)
            asks, own = pickle.dumps((queries, uids, best.floor)), best.rows(uids).to_pylist()
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("uid", pa.int64()), ("score", pa.int64()), ("id", pa.int64())]))]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([number, dim, cell, reach, pickle.dumps((tree, ids)), asks, own], kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, open_, key = TaskContext.get().partitionId() << 32, 0, [], None
        for batch in batches:
            for uid, dim, cell, v, ids, asked in zip(*(batch.column(c).to_pylist() for c in ("uid", "dim", "cell", "v", "ids", "wanted")), strict=True):
                if open_ and (key != (dim, cell) or len(open_) == block):
                    yield pack(*key, open_, part | made)
                    made, open_ = made + 1, []
                key = (dim, cell)
                open_.append((uid, v, ids, asked))
        if open_:
            yield pack(*key, open_, part | made)

    return run


def _visits(centers: dict[int, np.ndarray], reach: dict[tuple[int, int], float]):
    """The cells that a block's queries must visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, dim, raw in zip(batch.column("block").to_pylist(), batch.column("dim").to_pylist(), batch.column("asks").to_pylist(), strict=True):
                q, _, floor = pickle.loads(raw)
                c = centers.get(dim)
                if c is None:
                    rows.append((block, dim, -1, raw))
                    continue
                most = bounds(q.heads[0], q.head_norms[0], q.radius[0], c, np.sqrt((c * c).sum(1)), np.array([reach.get((dim, x), 0.0) for x in range(len(c))]))
                rows += [(block, dim, x, raw) for x in np.flatnonzero(most >= floor.min()).tolist() if (dim, x) in reach]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], ["from_block", "dim", "cell", "asks"])

    return run


def _meet(k: int):
    """Best rows of each block's queries in the blocks that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, uids = None, None, None
        for batch in batches:
            for block, asks, data in zip(batch.column("from_block").to_pylist(), batch.column("asks"), batch.column("data"), strict=True):
                if block != held:
                    if best:
                        yield best.rows(uids)
                    queries, uids, floor = pickle.loads(asks.as_buffer())
                    held, best = block, Best(queries, k, floor)
                best.search(*pickle.loads(data.as_buffer()))
        if best:
            yield best.rows(uids)

    return run


def nearest(vectors: DataFrame, wanted: Column, *, k: int = 5, block: int = 2048, cells: int = 256, sample: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each wanted row with all other rows.

    ``vectors`` has ``vec_id`` (long) and ``v`` (array of longs); ``wanted`` marks the queries
    (null: no query).  Ties go to the smaller id.  A query's own row is left out, rows that
    repeat its id or its vector are not: a repeated query row has results of its own.
    A row with a null id can be found, after all others of its score, and is returned
    as null (as is id 2^63 - 1).  Rows whose ``v`` is null or has a null, or is longer than
    2^31 in Euclid's sense (products could pass 64 bits), take no part; vectors of
    different lengths don't meet, empty ones have score 0.  With fewer than ``k`` other rows a query has all
    of them.  Other columns are ignored; an empty table gives an empty one.

    ``sample`` bounds what cells are fitted on; every row is indexed and results are
    exact.  A task holds a block of ``block`` vectors and the queries of another.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    textkit.bound_batches(spark)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = spread(vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("v").cast("array<bigint>").alias("v"), F.coalesce(wanted, F.lit(False)).alias("wanted")))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()) & (norm < float(2**62)))
    rows = scratch.keep(rows, "rows", compression="zstd")
    # of a vector's rows the k + 1 with the smallest ids, of queries and others apart, counted before the exchange too
    kept = rows.selectExpr("*", "row_number() over (partition by v, wanted order by id) as n").where(F.col("n") <= k + 1)
    classes = kept.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.max("wanted").alias("wanted"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("uid"), F.size("v").alias("dim"), "v", "ids", "wanted"), "classes")
    centers = fit_cells(classes, block, cells, sample)
    placed = classes.mapInArrow(_assign(centers), "uid bigint, dim int, v array<bigint>, ids array<bigint>, wanted boolean, cell int")
    placed = placed.repartitionByRange("dim", "cell", "uid").sortWithinPartitions("dim", "cell", "uid")
    blocks = scratch.keep(placed.mapInArrow(textkit.lean(_blocks(centers, block, k + 1)), _BLOCK), "blocks", **{"parquet.block.size": str(16 << 20)})
    reach = {(r["dim"], r["cell"]): r["reach"] for r in blocks.where("cell >= 0").groupBy("dim", "cell").agg(F.max("reach").alias("reach")).collect()}
    visits = blocks.where("asks is not null").select("block", "dim", "asks").mapInArrow(_visits(centers, reach), "from_block bigint, dim int, cell int, asks binary")
    pairs = visits.join(blocks.select("block", "dim", "cell", "data"), ["dim", "cell"]).where("from_block <> block").select("from_block", "asks", "data")
    found = pairs.mapInArrow(textkit.lean(_meet(k + 1)), "uid bigint, score bigint, id bigint")
    found = found.unionByName(blocks.where("asks is not null").select(F.explode("own").alias("o")).select("o.uid", "o.score", "o.id"))
    found = found.selectExpr("*", "row_number() over (partition by uid order by score desc, id) as n").where(F.col("n") <= k + 1)
    tops = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("top"))
    tops = scratch.keep(classes.where("wanted").select("uid", "v").join(tops, "uid").select("v", "top"), "tops")
    scratch.drop("classes", "blocks")
    own = F.struct((-F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)).alias("less"), "id")
    asked = rows.where("wanted").join(tops, "v").select("id", "top", F.array_position("top", own).alias("mine"))
    others = F.slice(F.filter("top", lambda _, i: i + 1 != F.col("mine")), 1, k)
    asked = asked.select(F.col("id").alias("query_id"), F.posexplode(others).alias("i", "t"))
    return asked.select("query_id", (F.col("i") + 1).alias("rank"), F.nullif(F.col("t.id"), F.lit(NO_ID)).alias("vec_id"), (-F.col("t.less")).alias("score"))
