"""What both vector operators share: well-formed vectors, one a row id, and dealing them to cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample for each centre that is fitted to it; centres that are searched one by one; groups of centres that a vector is held against beyond that.
PER, FLAT, TOPS = 16, 64, 4
_PARTS = 1 << 40


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def clean(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): of rows with an id and a finite vector of the most frequent length; of those with one id the least vector."""
    v = F.col(vector).cast("array<double>")
    good = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    good = good.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return good.filter(F.size("v") == (sizes[0][0] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, of all pairs."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to k centres by k-means, begun from rows far apart in the order given."""
    centres = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0) if len(x) else x[:0]
    for _ in range(rounds if len(centres) > 1 else 0):
        near = distances(x, centres).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], (np.cumsum(count) - count)[some], 0)
        centres = sums / count[some, None]
    return centres


class Centres:
    """Points that vectors are dealt to; beyond FLAT of them in groups round points of their own, so that k centres cost some sqrt(k) distances a vector."""

    def __init__(self, groups: list[np.ndarray]):
        self.groups = [g for g in groups if len(g)]
        self.points = np.concatenate(self.groups)
        self.tops = np.array([g.mean(0) for g in self.groups])
        self.first = np.cumsum([0, *map(len, self.groups)])

    def __len__(self) -> int:
        return len(self.points)

    @classmethod
    def fit(cls, x: np.ndarray, k: int) -> Centres:
        if k <= FLAT:
            return cls([_means(x, k)])
        tops = _means(x, round(k**0.5))
        near = distances(x, tops).argmin(1)
        parts = [x[near == j] for j in range(len(tops))]
        return cls([_means(p, max(1, round(k * len(p) / len(x)))) for p in parts if len(p)])

    def near(self, x: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``cells`` centres of each vector, of the groups looked at, and their distances; -1 and infinity where there are fewer."""
        at, d = np.full((len(x), cells), -1), np.full((len(x), cells), np.inf)
        which = np.zeros((len(x), 1), int)
        if len(self.groups) > 1:
            far = distances(x, self.tops)
            which = np.argsort(far, 1, kind="stable")[:, :TOPS]
        for g in np.unique(which):
            rows = np.flatnonzero((which == g).any(1))
            own = distances(x[rows], self.groups[g])
            both = np.concatenate([d[rows], own], 1)
            names = np.concatenate([at[rows], np.broadcast_to(np.arange(self.first[g], self.first[g + 1]), own.shape)], 1)
            best = np.argsort(both, 1, kind="stable")[:, :cells]
            d[rows], at[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
        return at, d

    def split(self, cells: dict[int, np.ndarray]) -> Centres:
        """Other centres in place of some; all are grouped anew."""
        points = np.concatenate([cells.get(i, p[None]) for i, p in enumerate(self.points)])
        if len(points) <= FLAT:
            return Centres([points])
        near = distances(points, _means(points, round(len(points) ** 0.5))).argmin(1)
        return Centres([points[near == j] for j in np.unique(near)])


def sample(table: DataFrame, n: int, most: int) -> np.ndarray:
    """About ``most`` of the table's n vectors, by the hashes of their ids and in that order."""
    share = table.select("id", "v") if most >= n else table.filter(F.pmod(F.xxhash64("id"), F.lit(_PARTS)) < int(most / n * _PARTS)).select("id", "v")
    found = share.withColumn("h", F.xxhash64("id")).toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    return matrix(found.column("v"))


def _homes(centres: Centres, share: dict[int, float] | None):
    """(cell, rows) of each batch, or with shares that part of each cell's rows: (cell, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            cell = centres.near(matrix(rows.column("v")), 1)[0][:, 0]
            if share is None:
                some, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n)], ["cell", "n"])
                continue
            odds = rows.column("h").to_numpy() / float(1 << 32)
            taken = np.flatnonzero(odds < np.array([share.get(int(c), 0.0) for c in cell]))
            yield pa.RecordBatch.from_arrays([pa.array(cell[taken]), rows.column("v").take(pa.array(taken))], ["cell", "v"])

    return run


def centres_of(table: DataFrame, n: int, size: int, rounds: int = 6) -> tuple[Centres, dict[int, int]]:
    """Centres of cells of about ``size`` rows, and each cell's rows.

    They are fitted to a sample of PER rows a centre; all rows are counted, and a cell of more than
    three times ``size`` is split by centres fitted to a sample of its own rows, as often as that helps.
    """
    k = max(1, -(-n // size))
    centres = Centres.fit(sample(table, n, PER * k), k)
    while True:
        counted = table.select("v").mapInArrow(_homes(centres, None), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts = dict(zip(counted.column("cell").to_pylist(), counted.column("n").to_pylist(), strict=True))
        big = {c: m for c, m in counts.items() if m > 3 * size}
        rounds -= 1
        if not big or not rounds:
            return centres, counts
        share = {c: PER * -(-m // size) / m for c, m in big.items()}
        hashed = table.select("v", F.shiftrightunsigned(F.xxhash64("id"), 32).alias("h"))
        rows = hashed.mapInArrow(_homes(centres, share), "cell long, v array<double>").toArrow()
        x, cell = matrix(rows.column("v")), rows.column("cell").to_numpy()
        new = {c: np.unique(_means(x[cell == c], -(-m // size)), axis=0) for c, m in big.items() if (cell == c).any()}
        new = {c: p for c, p in new.items() if len(p) > 1}
        if not new:
            return centres, counts
        centres = centres.split(new)
