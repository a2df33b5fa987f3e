"""Exact top-k inner-product search with M-trees.

Method. A vector x of integers gets one more component, sqrt(M**2 - |x|**2), with M the largest
norm; queries get 0 there. Euclidean distance then orders candidates exactly as the inner product
does, so a metric tree applies. Pivots far from each other, from the SAMPLE rows of smallest hash,
cut the space into at most REGIONS regions, one for each REGION_ROWS rows; every row goes to its
nearest pivot's, and a region's rows go by hash to trees of about TREE_ROWS vectors, so equal or
crowded vectors fill more trees and none grows. The regions' pivots and covering radii (at most
REGIONS rows) are the top node. A query first asks one tree of its nearest region, which gives its
k-th best score so far, and then the trees of only those regions that the triangle inequality
admits under that bound.

A tree is paged: a node holds up to PAGE entries, each with its routing vector, covering radius and
the distance to its parent's routing vector. A search takes pages best-first by the least distance
they may hold, and before working out a distance tests the stored ones: by the triangle
inequality |d(q, parent) - d(entry, parent)| - radius bounds it from below. It ends when the next
page can't beat the k-th best. Bounds are in floating point with SLACK. Scores are exact: in floats
while sums stay below 2**53, in 64-bit integers below 2**62, else in Python's integers; ties go to
the smaller id. A component beyond the range of a long is taken for the nearest long, and so is a
score, after the ranks have been settled by the exact one.

Defined results: vectors that are null, hold null or non-finite components take no part as query or
candidate, nor do rows without an id; shorter vectors count as filled with zeros; rows that repeat
an id are candidates of their own, and each distinct vector of a repeated query id is a query with
ranks of its own; no candidate has the query's id; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import runtime

PAGE = 64
TREE_ROWS = 16_384
#: Rows that pivots are chosen from, rows that a region is planned for, and regions at most.
SAMPLE = 2048
REGION_ROWS = 65_536
REGIONS = 256
#: Queries that share one search, and that travel together to a tree, at most.
BLOCK = 256
SENT = 16_384
SLACK = 1e-6
LONG = 2**63 - 1
#: The largest double that is a long.
EDGE = 9223372036854774784.0


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of each usable vector."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(x.isNotNull() & ~bad).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(EDGE)), F.lit(-EDGE)))).alias("v"))


def kind_of(largest: int) -> type:
    """The numbers in which sums of products up to ``largest`` are exact."""
    return np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 62 else object


def lifted(rows: np.ndarray, norm: float) -> np.ndarray:
    """The rows with the component that gives them all one norm."""
    x = rows.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))])


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of integers, filled with zeros to one width."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    width = max(width, int(size.max(initial=0)))
    out = np.zeros((len(size), width), np.int64)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = np.asarray(lists.flatten())
    return out


class Tree:
    """An M-tree over integer rows, bulk-loaded.

    Arrays of a node: first entry and number of entries; of an entry: the row that routes, the
    covering radius (0 in leaves), the distance to the parent's routing vector, and the child node
    (-1 in leaves).
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, norm: float) -> None:
        self.ids, self.rows = ids, rows
        self.points = lifted(rows, norm)
        self.nodes: list[tuple[int, int]] = []
        self.route: list[np.ndarray] = []
        self.radius: list[np.ndarray] = []
        self.up: list[np.ndarray] = []
        self.child: list[np.ndarray] = []
        self.count = 0
        self.root = self._load(np.arange(len(ids)), None)
        for name in ("route", "radius", "up", "child"):
            setattr(self, name, np.concatenate(getattr(self, name)) if self.count else np.zeros(0))

    def _far(self, rows: np.ndarray, to: int | None) -> np.ndarray:
        if to is None:
            return np.zeros(len(rows))
        return np.sqrt(((self.points[rows] - self.points[to]) ** 2).sum(1))

    def _page(self, route: np.ndarray, radius: np.ndarray, up: np.ndarray, child: np.ndarray) -> int:
        self.nodes.append((self.count, len(route)))
        self.count += len(route)
        for have, new in ((self.route, route), (self.radius, radius), (self.up, up), (self.child, child)):
            have.append(new)
        return len(self.nodes) - 1

    def _load(self, rows: np.ndarray, parent: int | None) -> int:
        if len(rows) <= PAGE:
            return self._page(rows, np.zeros(len(rows)), self._far(rows, parent), np.full(len(rows), -1))
        # Seeds far from each other, then every row to its nearest seed; parts too large are halved along the order of distance.
        k = min(PAGE, -(-len(rows) // (PAGE // 2)))
        seeds = [rows[0]]
        near = self._far(rows, seeds[0])
        owner = np.zeros(len(rows), np.int64)
        while len(seeds) < k and near.max() > 0:
            s = rows[int(near.argmax())]
            d = self._far(rows, s)
            owner[d < near] = len(seeds)
            near = np.minimum(near, d)
            seeds.append(s)
        parts = [rows[owner == i] for i in range(len(seeds))]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # equal points
            parts = np.array_split(rows, k)
        route, radius, child = [], [], []
        for p in parts:
            centre = self.points[p].mean(0)
            r = int(p[((self.points[p] - centre) ** 2).sum(1).argmin()])
            route.append(r)
            radius.append(float(self._far(p, r).max()))
            child.append(self._load(p, r))
        route = np.array(route)
        return self._page(route, np.array(radius), self._far(route, parent), np.array(child))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None, kind: type = np.float64) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
        """([(score, -id)] of the k best of each query, distances worked out for each).

        least: scores that candidates must reach, per query (-infinity: any). A block of queries shares
        one best-first queue: a page's place is the least distance that it may hold for any of them,
        and a query takes part in a page only while its own bound allows.
        """
        m = len(queries)
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(m)]
        worked = np.zeros(m, np.int64)
        if not self.count or not m:
            return heaps, worked
        q = np.column_stack([queries, np.zeros(m)]).astype(np.float64)
        exact, held = queries.astype(kind), self.rows.astype(kind)
        q_sq = (q**2).sum(1)
        norm2 = float((self.points[0] ** 2).sum())
        far = lambda s, j: np.sqrt(np.maximum(0.0, q_sq[j] + norm2 - 2.0 * s)) * (1 + SLACK) + SLACK
        least = np.full(m, -np.inf) if least is None else least.astype(np.float64)  # the k-th best score so far
        limit = np.where(np.isinf(least), np.inf, far(np.where(np.isinf(least), 0, least), np.arange(m)))
        serial = 0
        queue: list = [(0.0, 0, self.root, np.zeros(m), None)]
        while queue:
            low, _, node, lows, to_parent = heapq.heappop(queue)
            if low > limit.max():
                break
            on = np.flatnonzero(lows <= limit)
            if not len(on):
                continue
            first, n = self.nodes[node]
            e = np.arange(first, first + n)
            if to_parent is not None:
                near = np.abs(to_parent[on][:, None] - self.up[e][None, :]) - self.radius[e][None, :] <= limit[on][:, None]
                e = e[near.any(0)]
                on = on[near.any(1)]
                if not len(e):
                    continue
            r = self.route[e]
            worked[on] += len(e)
            child = self.child[e]
            if child[0] < 0:
                scores = exact[on] @ held[r].T
                ids = self.ids[r]
                # Beyond 2**53 a float may round a score either way.
                hits = scores >= least[on][:, None] if kind is np.float64 else scores.astype(np.float64) >= least[on][:, None] - np.abs(least[on][:, None]) * 1e-15
                for i in np.flatnonzero(hits.any(1)).tolist():
                    j = int(on[i])
                    heap, mine = heaps[j], int(own[j])
                    cols = np.flatnonzero(hits[i])
                    for s, d in zip(scores[i, cols].tolist(), ids[cols].tolist(), strict=True):
                        if d == mine:
                            continue
                        entry = (int(s), -d)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                    if len(heap) == k and heap[0][0] >= least[j]:
                        least[j] = heap[0][0]
                        limit[j] = far(least[j], j)
            else:
                d2 = q_sq[on][:, None] + norm2 - 2.0 * (q[on] @ self.points[r].T)
                d = np.sqrt(np.maximum(d2, 0))
                # Near 0 the difference of squares is uncertain by its terms' rounding.
                near = np.maximum(d - self.radius[e][None, :] - SLACK * (1 + d) - np.sqrt(1e-14 * (q_sq[on][:, None] + norm2)), 0)
                for c in range(len(e)):
                    least_of = float(near[:, c].min())
                    if least_of <= limit.max():
                        lows_c, far_c = np.full(m, np.inf), np.zeros(m)
                        lows_c[on], far_c[on] = near[:, c], d[:, c]
                        serial += 1
                        heapq.heappush(queue, (least_of, serial, int(child[c]), lows_c, far_c))
        return heaps, worked

    def dump(self) -> bytes:
        out = io.BytesIO()
        small = bool(len(self.rows)) and -(2**31) <= self.rows.min(initial=0) and self.rows.max(initial=0) < 2**31
        np.savez(out, ids=self.ids, rows=self.rows.astype(np.int32) if small else self.rows, points=self.points, nodes=np.array(self.nodes).reshape(-1, 2), route=self.route, radius=self.radius, up=self.up, child=self.child, root=np.array(self.root))
        return out.getvalue()

    @classmethod
    def read(cls, data: bytes) -> Tree:
        z = np.load(io.BytesIO(data))
        tree = cls.__new__(cls)
        for name in ("ids", "points", "route", "radius", "up", "child"):
            setattr(tree, name, z[name])
        tree.rows = z["rows"].astype(np.int64)
        tree.nodes = [tuple(n) for n in z["nodes"].tolist()]
        tree.root, tree.count = int(z["root"]), len(tree.route)
        return tree


def pivots(vectors: DataFrame, count: int, norm: float, width: int) -> np.ndarray:
    """Lifted vectors far from each other, out of the SAMPLE rows of smallest hash."""
    sample = matrix(vectors.select("id", "v").orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow()["v"].combine_chunks(), width)
    points = lifted(sample, norm)
    chosen = [int(((points - points.mean(0)) ** 2).sum(1).argmin())]
    near = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _far(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances, with an allowance for rounding taken off by the caller."""
    a, b = (points**2).sum(1), (to**2).sum(1)
    return np.sqrt(np.maximum(a[:, None] + b[None, :] - 2 * (points @ to.T), 0))


def regions(vectors: DataFrame, at: np.ndarray, norm: float, width: int) -> DataFrame:
    """The vectors with their region and the distance to its pivot."""
    shared = vectors.sparkSession.sparkContext.broadcast(at)  # REGIONS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                far = _far(lifted(matrix(b.column(1), width), norm), shared.value)
                own = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], ["id", "v", "region", "far"])

    return vectors.select("id", "v").mapInArrow(run, "id bigint, v array<bigint>, region int, far double")


def build(dealt: DataFrame, norm: float, width: int) -> DataFrame:
    """(tree, data): the serialised M-tree of each part of the vectors (id, v, tree)."""

    def run(key, table):
        tree = Tree(table["id"].to_numpy(), matrix(table["v"], width), norm)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([tree.dump()], pa.binary())})

    return dealt.groupBy("tree").applyInArrow(run, "tree int, data binary")


def _order(score: Column, kind: type) -> Column:
    """What exact scores sort by; those beyond 64 bits are decimal text."""
    if kind is not object:
        return score
    digits = F.lpad(F.regexp_replace(score, "^-", ""), 60, "0")
    return F.when(score.startswith("-"), F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), digits))


def _long(score: Column, kind: type) -> Column:
    """The score, or the end of a long's range that it lies beyond."""
    if kind is not object:
        return score
    digits = F.regexp_replace(score, "^-", "")
    fits = (F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= str(LONG)))
    return F.when(fits, score.try_cast("bigint")).when(score.startswith("-"), F.lit(-LONG - 1)).otherwise(F.lit(LONG))


def _searched(asked: DataFrame, index: DataFrame, blocks: int, k: int, width: int, kind: type) -> DataFrame:
    """The k best of each tree for the queries (query, id, v, least, tree) that ask it, in blocks of queries."""
    text = kind is object

    def run(key, queries, tree):
        out: list[tuple] = []
        if queries.num_rows and tree.num_rows:
            t = Tree.read(tree["data"][0].as_py())
            number, ids, rows = queries["query"].to_numpy(), queries["id"].to_numpy(), matrix(queries["v"], width)
            least = queries["least"].combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
            for j in range(0, len(ids), BLOCK):
                part = slice(j, j + BLOCK)
                found, worked = t.search(rows[part], ids[part], k, least[part], kind)
                for q, own, heap, w in zip(number[part].tolist(), ids[part].tolist(), found, worked.tolist(), strict=True):
                    out += [(q, own, -d, str(s) if text else s, 0) for s, d in heap]
                    out.append((q, own, None, None, w))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if text else pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "query_id", "vec_id", "score", "compared"])

    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    told = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.groupBy("tree", "block").cogroup(told.groupBy("tree", "block")).applyInArrow(run, f"query bigint, query_id bigint, vec_id bigint, score {'string' if text else 'bigint'}, compared bigint")


def top_k(df: DataFrame, k: int = 20, query_step: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tree_rows: int = TREE_ROWS, region_rows: int = REGION_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score, n_compared): for each row whose id is divisible by query_step, its k best among the
    other rows, and how many distances its search worked out (of as many as there are rows)."""
    spark = df.sparkSession
    vectors = runtime.store(quantised(df, id_col, vector_col).where("id is not null"), "vectors")
    sq = F.aggregate("v", F.lit(0).cast("double"), lambda s, c: s + c.cast("double") * c.cast("double"))
    about = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(sq).alias("m"), F.max(F.size("v")).alias("w")).first()
    n, width = about["n"], about["w"] or 0
    norm = float(about["m"] or 0) ** 0.5
    kind = kind_of(int(2 * (about["m"] or 0)) + 1)
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint, n_compared bigint")
    at = pivots(vectors, min(REGIONS, max(1, -(-n // region_rows))), norm, width)
    placed = runtime.store(regions(vectors, at, norm, width), "regions")
    runtime.discard(vectors)
    sizes = {r["region"]: (r["n"], r["far"]) for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # REGIONS rows
    trees_of = np.array([-(-sizes[r][0] // tree_rows) if r in sizes else 0 for r in range(len(at))])
    first = np.cumsum(trees_of) - trees_of
    radius = np.array([sizes[r][1] if r in sizes else -np.inf for r in range(len(at))])
    trees = int(trees_of.sum())
    by_region = lambda a: F.get(F.array(*[F.lit(int(x)) for x in a]), F.col("region"))
    number = F.pmod(F.xxhash64("id", "v"), F.greatest(by_region(trees_of), F.lit(1)))
    index = runtime.store(build(placed.select("id", "v", (by_region(first) + number).cast("int").alias("tree")), norm, width), "trees")

    blocks = max(1, -(-n // query_step // SENT), min(-(-n // query_step // BLOCK), -(-2 * runtime.partitions(spark) // trees)))
    queries = placed.where(F.col("id") % query_step == 0).select(F.xxhash64("id", "v").alias("query"), "id", "v", "region").distinct()
    home = queries.withColumn("tree", (by_region(first) + F.pmod(F.col("query"), F.greatest(by_region(trees_of), F.lit(1)))).cast("int")).withColumn("least", F.lit(None).cast("double"))
    one = runtime.store(_searched(home, index, blocks, k, width, kind), "found-at-home")

    bound = one.where("score is not null").groupBy("query").agg(F.count(F.lit(1)).alias("held"), F.min(F.col("score").cast("double")).alias("least"))
    # A float may round the bound up: a little less is still a bound.
    bound = bound.select("query", F.when(F.col("held") >= k, F.col("least") - F.abs("least") * 1e-15).alias("least"))
    shared = spark.sparkContext.broadcast((at, radius, first, trees_of))

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, radius, first, trees_of = shared.value
        norm2 = norm**2
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                q = np.column_stack([matrix(b.column(2), width), np.zeros(b.num_rows)]).astype(np.float64)
                q_sq = (q**2).sum(1)
                least = b.column(4).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                limit = np.where(np.isinf(least), np.inf, np.sqrt(np.maximum(0, q_sq + norm2 - 2 * np.where(np.isinf(least), 0, least))) * (1 + SLACK) + SLACK)
                low = _far(q, at) - radius[None, :] - 2 * np.sqrt(1e-14 * (q_sq[:, None] + norm2)) - SLACK
                row, region = np.nonzero((low <= limit[:, None]) & (trees_of > 0)[None, :])
                many = trees_of[region]
                row = np.repeat(row, many)
                tree = np.repeat(first[region], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                keep = tree != b.column(3).to_numpy()[row]
                for j in range(0, int(keep.sum()), 4096):
                    r = pa.array(row[keep][j : j + 4096])
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(r) for c in (0, 1, 2)], pa.array(tree[keep][j : j + 4096].astype(np.int32)), b.column(4).take(r)], ["query", "id", "v", "tree", "least"])

    rest = home.drop("least", "region").join(bound, "query", "left").select("query", "id", "v", "tree", "least")
    rest = rest.mapInArrow(admit, "query bigint, id bigint, v array<bigint>, tree int, least double")
    both = one.unionByName(_searched(rest, index, blocks, k, width, kind))
    compared = both.groupBy("query").agg(F.sum("compared").alias("n_compared"))
    order = Window.partitionBy("query").orderBy(_order(F.col("score"), kind).desc(), "vec_id")
    best = both.where("score is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(compared, "query").select("query_id", "rank", "vec_id", _long(F.col("score"), kind).alias("score"), "n_compared")
