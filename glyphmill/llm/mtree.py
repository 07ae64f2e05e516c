"""Exact top-k search by M-trees.

Rows are dealt to cells of about ``CELL``, each to its nearest centre, and a cell that holds too many is
split by further centres. Each cell becomes an M-tree, built once and kept as a row: its pages
(``PAGE`` entries) hang under routing nodes, all with a pivot, a covering radius and the distance to
their parent. A query searches the ``FIRST`` cells nearest to it; with the k-th distance found there as
its bound it is sent to those other cells that it may reach, by their covering radius and by the least
and greatest distances of their rows to ``RINGS`` pivots, and the lists are merged. Within a tree
each query takes its best node first; batches of queries that are at the same node are computed
together. Stored parent distances exclude nodes and entries before any distance to them is computed.

What every task is given of the cells, centres, radii and rings, takes some 3 KB for each; cells grow
so that it stays under ``TABLE`` bytes.

Defined results: rows without an id or with a vector that is null, empty, not finite or of another
than the most frequent length are left out; of rows with one id the least vector counts; a row isn't
its own neighbour; ties in distance go by id; with fewer than k other rows all of them are returned.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm import vectors as vs
from glyphmill.llm.scratch import Scratch

K, PAGE, FAN, CELL, FIRST, RINGS, TABLE, SLACK = 10, 64, 12, 2048, 3, 32, 256 << 20, 1e-7


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """n rows that lie far from each other."""
    chosen = [0]
    d = vs.distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)):
        i = int(d.argmax())
        if d[i] == 0:
            break
        chosen.append(i)
        d = np.minimum(d, vs.distances(x, x[i : i + 1])[:, 0])
    return np.array(chosen)


class Tree:
    """Root, routing nodes, pages; built at once from all entries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.root = self.x.mean(0) if len(x) else np.zeros(x.shape[1])
        pages: list[np.ndarray] = []
        self.inner, self.inner_pages = [], []
        for part in self._split(np.arange(len(x)), max(1, round(len(x) / PAGE / FAN))):
            own = []
            for page in self._split(part, max(1, -(-len(part) // PAGE))):
                for lo in range(0, len(page), PAGE):  # a page of more entries goes on in another
                    own.append(len(pages))
                    pages.append(page[lo : lo + PAGE])
            pivot = self.x[part].mean(0)
            self.inner.append((pivot, vs.distances(self.x[part], pivot[None])[:, 0].max(), float(np.linalg.norm(pivot - self.root))))
            self.inner_pages.append(np.array(own))
        self.pages = pages
        self.pivot = np.array([self.x[p].mean(0) for p in pages]) if pages else np.zeros((0, x.shape[1]))
        self.entry_far = [vs.distances(self.x[p], self.pivot[i : i + 1])[:, 0] for i, p in enumerate(pages)]
        self.radius = np.array([d.max() for d in self.entry_far])
        self.to_parent = np.zeros(len(pages))
        for (pivot, _, _), own in zip(self.inner, self.inner_pages, strict=True):
            self.to_parent[own] = vs.distances(self.pivot[own], pivot[None])[:, 0]
        self.computed = self.avoided = 0

    def _split(self, rows: np.ndarray, n: int) -> list[np.ndarray]:
        if n <= 1 or len(rows) <= 1:
            return [rows] if len(rows) else []
        near = vs.distances(self.x[rows], self.x[rows[_spread(self.x[rows], n)]]).argmin(1)
        return [rows[near == j] for j in np.unique(near)]

    def search(self, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, id) of the up to k nearest entries other than the query's own id and no farther than its bound."""
        m, inner = len(q), len(self.inner)
        if not m or not inner:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        best = np.full((m, k), np.inf)
        who = np.zeros((m, k), np.int64)
        bound = bound.copy()
        low = np.full((m, inner + len(self.pages)), np.inf)
        pivot_far = np.zeros((m, len(self.pages)), np.float32)
        to_root = vs.distances(q, self.root[None])[:, 0]
        inner_far = np.zeros((m, inner))
        for i, (pivot, radius, far) in enumerate(self.inner):
            by_parent = np.abs(to_root - far) - radius
            some = np.flatnonzero(by_parent <= bound + SLACK)
            self.computed += len(some)
            self.avoided += m - len(some)
            inner_far[some, i] = vs.distances(q[some], pivot[None])[:, 0]
            low[some, i] = np.maximum(inner_far[some, i] - radius, 0)
        every = np.arange(m)
        while True:
            node = low.argmin(1)
            # a bound stays infinite as long as there are fewer than k entries
            active = np.flatnonzero(np.isfinite(low[every, node]) & (low[every, node] <= bound + SLACK))
            if not len(active):
                break
            low[active, node[active]] = np.inf
            order = active[np.argsort(node[active], kind="stable")]
            at = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
            for rows in np.split(order, at[1:]):
                j = int(node[rows[0]])
                if j < inner:
                    own_pages = self.inner_pages[j]
                    by_parent = np.abs(inner_far[rows, j][:, None] - self.to_parent[own_pages]) - self.radius[own_pages]
                    needed = by_parent <= bound[rows][:, None] + SLACK
                    self.avoided += int((~needed).sum())
                    columns = np.flatnonzero(needed.any(0))
                    p = own_pages[columns]
                    d = vs.distances(q[rows], self.pivot[p])
                    self.computed += d.size
                    pivot_far[rows[:, None], p] = d
                    low[rows[:, None], inner + p] = np.where(needed[:, columns], np.maximum(np.maximum(d - self.radius[p], by_parent[:, columns]), 0), np.inf)
                    continue
                page = self.pages[j - inner]
                reach = bound[rows] + 1e-5  # parent distances are kept in single precision
                possible = np.abs(pivot_far[rows, j - inner][:, None] - self.entry_far[j - inner]) <= reach[:, None]
                columns = np.flatnonzero(possible.any(0))
                self.avoided += possible.size - len(columns) * len(rows)
                if not len(columns):
                    continue
                entries = page[columns]
                d = vs.distances(q[rows], self.x[entries])
                self.computed += d.size
                r, c = np.nonzero((d <= bound[rows][:, None] + SLACK) & (self.ids[entries] != own[rows][:, None]))
                if not len(r):
                    continue
                # computed again entry by entry, so that equal vectors are at equal distances
                exact = np.sqrt(((q[rows[r]] - self.x[entries[c]]) ** 2).sum(1))
                touched = np.unique(r)
                rr = np.concatenate([r, np.repeat(touched, k)])
                dd = np.concatenate([exact, best[rows[touched]].ravel()])
                ii = np.concatenate([self.ids[entries[c]], who[rows[touched]].ravel()])
                o = np.lexsort((ii, dd, rr))
                rr, dd, ii = rr[o], dd[o], ii[o]
                begin = np.searchsorted(rr, touched)
                take = begin[:, None] + np.arange(k)
                best[rows[touched]], who[rows[touched]] = dd[take], ii[take]
                bound[rows[touched]] = np.minimum(bound[rows[touched]], dd[take][:, -1])
        r, c = np.nonzero(np.isfinite(best))
        return r, best[r, c], who[r, c]


FOUND = "id long, other long, d double"


def _built(pivots: np.ndarray):
    """The tree of a cell as a row, with its centre, radius and the rings its rows lie in."""

    def run(table: pa.Table) -> pa.Table:
        x = vs.matrix(table.column("v"))
        tree = Tree(table.column("id").to_numpy(), x)
        far = vs.distances(x, pivots)
        own = np.concatenate([tree.root, [vs.distances(x, tree.root[None]).max()], far.min(0), far.max(0)])
        return pa.table([*(table.column(c).slice(0, 1) for c in ("cell", "part")), vs.lists(own[None]), pa.array([pickle.dumps(tree, 5)], pa.binary())], names=["cell", "part", "about", "tree"])

    return run


def _visit(k: int):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if trees.num_rows and queries.num_rows:
            tree = pickle.loads(trees.column("tree")[0].as_py())
            ids, q, bound = queries.column("id").to_numpy(), vs.matrix(queries.column("v")), queries.column("bound").to_numpy()
            for lo in range(0, len(ids), 4096):
                r, d, other = tree.search(q[lo : lo + 4096], ids[lo : lo + 4096], bound[lo : lo + 4096], k)
                for out, v in zip(found, (ids[lo + r], other, d), strict=True):
                    out.append(v)
        return pa.table([np.concatenate(f) for f in found], names=["id", "other", "d"])

    return run


class Cells:
    """What is known of all cells, to tell which of them a query may reach."""

    def __init__(self, rows: pa.Table, pivots: np.ndarray):
        self.cell, self.part = rows.column("cell").to_numpy(), rows.column("part").to_numpy()
        about = vs.matrix(rows.column("about"))
        d, p = pivots.shape[1], len(pivots)
        self.root, self.radius, self.low, self.high, self.pivots = about[:, :d], about[:, d], about[:, d + 1 : d + 1 + p], about[:, d + 1 + p :], pivots

    def first(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                near = np.argsort(vs.distances(vs.matrix(rows.column("v")), self.root), 1, kind="stable")[:, :FIRST]
                yield self._sent(rows, np.repeat(np.arange(rows.num_rows), near.shape[1]), near.ravel(), np.full(near.size, np.inf))

    def reached(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells, other than the first ones, that each query's bound reaches."""
        for rows in batches:
            if not rows.num_rows:
                continue
            q, bound = vs.matrix(rows.column("v")), rows.column("bound").to_numpy()
            d = vs.distances(q, self.root)
            least = d - self.radius
            for j in range(len(self.pivots)):
                ring = vs.distances(q, self.pivots[j : j + 1])
                np.maximum(least, np.maximum(ring - self.high[:, j], self.low[:, j] - ring), out=least)
            goes = least <= bound[:, None] + SLACK
            np.put_along_axis(goes, np.argsort(d, 1, kind="stable")[:, :FIRST], False, 1)
            r, c = np.nonzero(goes)
            yield self._sent(rows, r, c, bound[r])

    def _sent(self, rows: pa.RecordBatch, r: np.ndarray, c: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        which = pa.array(r)
        return pa.RecordBatch.from_arrays([rows.column("id").take(which), rows.column("v").take(which), pa.array(self.cell[c]), pa.array(self.part[c]), pa.array(bound)], ["id", "v", "cell", "part", "bound"])


def nearest(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, queries: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest other rows by Euclidean distance of each row, or of each row for which ``queries``, a condition on column id, holds."""
    out = [F.col("id").alias(id_col), "rank", F.col("other").alias("neighbor_id"), F.round("d", 6).alias("distance")]
    scratch = Scratch(spark, "mtree")
    table = scratch.put(vs.clean(rows, id_col, vector))
    n = table.count()
    if n < 2:
        return spark.createDataFrame([], f"`{id_col}` long, rank int, neighbor_id long, distance double")
    width = len(table.select("v").first()[0])
    size = max(CELL, -(-n * 8 * (width + 2 * RINGS + 1) // TABLE))
    centres, counts = vs.centres_of(table, n, size)
    # what no distance splits, equal vectors, is cut by hash
    parts = {c: -(-m // (3 * size)) for c, m in counts.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = centres.near(vs.matrix(b.column("v")), 1)[0][:, 0]
                part = b.column("h").to_numpy() % np.array([parts[int(c)] for c in cell])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell), pa.array(part)], ["id", "v", "cell", "part"])

    dealt = table.withColumn("h", F.xxhash64("id")).mapInArrow(deal, "id long, v array<double>, cell long, part long")
    pivots = centres.points[np.linspace(0, len(centres) - 1, min(RINGS, len(centres))).astype(int)]
    trees = scratch.put(dealt.groupBy("cell", "part").applyInArrow(_built(pivots), "cell long, part long, about array<double>, tree binary"))
    cells = Cells(trees.select("cell", "part", "about").toArrow(), pivots)
    asked = table if queries is None else table.filter(queries)
    sent = "id long, v array<double>, cell long, part long, bound double"
    visit = trees.select("cell", "part", "tree").groupBy("cell", "part")
    first = scratch.put(visit.cogroup(asked.mapInArrow(cells.first, sent).groupBy("cell", "part")).applyInArrow(_visit(k), FOUND))
    order = Window.partitionBy("id").orderBy("d", "other")
    best = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    bounds = best.groupBy("id").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = asked.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    rest = visit.cogroup(bounded.mapInArrow(cells.reached, sent).groupBy("cell", "part")).applyInArrow(_visit(k), FOUND)
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*out)
