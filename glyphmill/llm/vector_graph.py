"""Embedding near-deduplication on a robust-pruned flat graph.

Copies first: in chunks of ``CHUNK`` rows of a cell, vectors within half the threshold's angle of a
common centre become one node with a radius and a number of members, every two of whom are near
without being compared; nodes of chunks of one cell are condensed again. All other vectors are nodes
of their own.

Nodes are dealt to the shards of their ``OVERLAP`` nearest centres. Each shard's graph is built by
inserting nodes in growing batches: a greedy search for the candidates, robust pruning, reverse edges.
Adjacency lists of all shards are united. Every node then searches its own shard and those whose
border is within the pair's distance times ``GAP`` / sqrt(dimensions), greedily from the medoid for
``BEAM`` steps and on from every node in range; where a node in range is in other shards too, the
search goes on there, until there is no new shard. An audit holds rows, drawn until ``AUDIT_PAIRS``
of their pairs are known or ``AUDIT_ROWS`` of them are drawn (the documented bound), against all
nodes by brute force; below a recall of ``RECALL``, averaged over rows with partners, everything is
done again with twice the gap and steps. Pairs of nodes are near for all members, or are
verified member by member, in blocks, with exact cosines.

Defined results: rows without an id or with a vector that is null, empty, zero, not finite or of
another than the most frequent length are left out; of rows with one id the least vector counts;
rows with parallel vectors are partners. A vector without a partner is a class of its own with 0
links. Where the audit finds no pair, recall is not known, which is logged.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import vectors as vs
from glyphmill.llm.components import components
from glyphmill.llm.scratch import Scratch

THRESHOLD, SHARD, CHUNK = 0.95, 1500, 2048
CANDIDATES, DEGREE, ALPHA, BEAM, OVERLAP, GAP = 40, 24, 1.2, 24, 2, 1.25
AUDIT_PAIRS, AUDIT_ROWS, RECALL = 200, 4096, 0.97
BLOCK, NONE, SLACK = 512, np.float32(-2), 1e-9
NODE = "id long, node long, v array<double>, r double, m long"
log = logging.getLogger(__name__)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of unit vectors row by row; exact near 0."""
    return 2 * np.arcsin(np.minimum(np.linalg.norm(x - y, axis=-1) / 2, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / max(np.linalg.norm(x), 1e-300)


def condense(x: np.ndarray, r: np.ndarray, m: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each row (-1: alone), and the groups' centres and radii, at most ``limit``, that hold all that their rows stand for."""
    owner, centres, radii = np.full(len(x), -1), [], []
    f = x.astype(np.float32)
    near = f @ f.T >= np.cos(min(1.5 * limit, np.pi))
    count = near.sum(1)
    for i in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
        if owner[i] >= 0:
            continue
        c = np.flatnonzero(near[i] & (owner < 0))
        for _ in range(3):
            if len(c) < 2:
                break
            centre = _unit((x[c] * m[c, None]).sum(0))
            far = angles(x[c], centre) + r[c]
            if far.max() <= limit:
                owner[c] = len(centres)
                centres.append(centre)
                radii.append(float(far.max()))
                break
            c = c[far <= limit]
    return owner, np.array(centres).reshape(-1, x.shape[1]), np.array(radii)


def _condense(limit: float):
    """Rows (id, node) of one chunk, each node's own row with its centre, radius and members."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, x = table.column("id").to_numpy(), vs.matrix(table.column("v"))
        r, m = table.column("r").to_numpy().copy(), table.column("m").to_numpy().copy()
        owner, centres, radii = condense(x, r, m, limit)
        node, x = ids.copy(), x.copy()
        grouped = np.flatnonzero(owner >= 0)
        first = np.zeros(len(centres), np.int64)
        first[owner[grouped][::-1]] = grouped[::-1]  # the least id
        node[grouped] = ids[first[owner[grouped]]]
        x[first], r[first], m[first] = centres, radii, np.bincount(owner[grouped], m[grouped], len(centres))
        own = pa.array(ids == node)
        v = pa.compute.if_else(own, vs.lists(x), pa.scalar(None, pa.list_(pa.float64())))
        return pa.table([pa.array(ids), pa.array(node), v, pa.array(r), pa.array(m)], names=["id", "node", "v", "r", "m"])

    return run


def robust_prune(x: np.ndarray, node: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates (nearest first, -1: none): up to ``degree``, each nearer to the node than ALPHA times to any kept before; -1 fills."""
    out = np.full((len(node), degree), -1, np.int64)
    for lo in range(0, len(node), 128):
        c = near[lo : lo + 128]
        v = x[np.maximum(c, 0)]
        to_node = np.where(c >= 0, 1 - np.einsum("nd,nld->nl", x[node[lo : lo + 128]], v), np.inf)
        between = 1 - v @ v.transpose(0, 2, 1)
        open_ = c >= 0
        rows = np.arange(len(c))
        for k in range(degree):
            i = np.where(open_, to_node, np.inf).argmin(1)
            some = open_[rows, i]
            if not some.any():
                break
            out[lo + rows[some], k] = c[rows, i][some]
            open_ &= ~(ALPHA * between[rows, i] <= to_node)
            open_[rows, i] = False
    return out


class Graph:
    """Unit vectors with up to DEGREE links each, by position."""

    def __init__(self, x: np.ndarray, links: np.ndarray | None = None):
        self.x = x.astype(np.float32)
        self.medoid = int((self.x @ self.x.mean(0)).argmax()) if len(x) else 0
        if links is None:
            self.links, self.count = np.full((len(x), DEGREE), -1), np.zeros(len(x), np.int64)
            self._build()
        else:
            self.links, self.count = links, (links >= 0).sum(1)

    def search(self, q: np.ndarray, floor: np.ndarray, steps: int) -> np.ndarray:
        """Similarities (queries x nodes) of the nodes come by, NONE elsewhere: the best ``steps`` nodes known are followed, and all at the query's floor or above."""
        sims = np.full((len(q), len(self.x)), NONE)
        sims[:, self.medoid] = q @ self.x[self.medoid]
        open_, live = sims.copy(), np.arange(len(q))
        step = 0
        while True:
            now = open_ if len(live) == len(q) else open_[live]
            nxt = now.argmax(1)
            best = now[np.arange(len(live)), nxt]
            goes = (best > NONE) & ((step < steps) | (best >= floor[live]))
            live, nxt = live[goes], nxt[goes]
            if not len(live):
                return sims
            step += 1
            open_[live, nxt] = NONE
            to = self.links[nxt]
            r, c = np.nonzero((to >= 0) & (sims[live[:, None], np.maximum(to, 0)] == NONE))
            rows, to = live[r], to[r, c]
            s = np.einsum("ij,ij->i", q[rows], self.x[to])
            sims[rows, to] = open_[rows, to] = s

    def _build(self) -> None:
        order = np.random.default_rng(5).permutation(len(self.x))
        order = np.concatenate([[self.medoid], order[order != self.medoid]]) if len(order) else order
        at = 0
        while at < len(order):
            batch = order[at : at + min(max(at, 64), BLOCK)]
            own = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(own, NONE)
            few = min(CANDIDATES if not at else CANDIDATES // 4, len(batch))
            i = np.argpartition(-own, few - 1, 1)[:, :few]
            s, near = np.take_along_axis(own, i, 1), batch[i]
            near = np.where(s > NONE, near, -1)
            if at:
                sims = self.search(self.x[batch], np.full(len(batch), np.inf), BEAM)
                i = np.argpartition(-sims, min(CANDIDATES, len(order)) - 1, 1)[:, :CANDIDATES]
                s = np.take_along_axis(sims, i, 1)
                near = np.concatenate([near, np.where(s > NONE, i, -1)], 1)
            kept = robust_prune(self.x, batch, near, DEGREE)
            self.links[batch] = kept
            self.count[batch] = (kept >= 0).sum(1)
            r, c = np.nonzero(kept >= 0)
            self._reverse(kept[r, c], batch[r])
            at += len(batch)

    def _reverse(self, of: np.ndarray, to: np.ndarray) -> None:
        """Adds links; a node with too many is pruned."""
        # what the node has already isn't added
        new = (self.links[of] != to[:, None]).all(1)
        of, to = of[new], to[new]
        order = np.argsort(of, kind="stable")
        of, to = of[order], to[order]
        nodes, starts, n = np.unique(of, return_index=True, return_counts=True)
        place = self.count[of] + np.arange(len(of)) - np.repeat(starts, n)
        wide = np.full((len(nodes), int((self.count[nodes] + n).max(initial=0))), -1)
        has = min(DEGREE, wide.shape[1])
        wide[:, :has] = self.links[nodes, :has]
        wide[np.repeat(np.arange(len(nodes)), n), place] = to
        over = self.count[nodes] + n > DEGREE
        self.links[nodes[~over], :has] = wide[~over, :has]
        self.links[nodes[over]] = robust_prune(self.x, nodes[over], wide[over], DEGREE)
        self.count[nodes] = (self.links[nodes] >= 0).sum(1)


def _build(table: pa.Table) -> pa.Table:
    """The nodes of a shard with the ids of those they are linked with."""
    links = Graph(vs.matrix(table.column("v"))).links
    has = links >= 0
    ids = table.column("id").to_numpy()
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has.sum(1))).astype(np.int32)), pa.array(ids[links[has]]))
    return pa.table([table.column("id"), table.column("v"), table.column("r"), table.column("cell"), lists], names=["id", "v", "r", "cell", "links"])


def _united(ids: np.ndarray, lists: pa.Array) -> np.ndarray:
    """The links within the shard, by position; those that lead out of it are followed there."""
    order = np.argsort(ids)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(ids)), sizes)
    i = np.minimum(np.searchsorted(ids[order], flat), len(ids) - 1)
    here = ids[order][i] == flat
    of, to = of[here], order[i[here]]
    count = np.bincount(of, minlength=len(ids))
    out = np.full((len(ids), max(int(count.max(initial=1)), 1)), -1)
    out[of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)] = to
    return out


def _search(theta: float, beam: int):
    """(a, b, d, cells): a query's pairs with nodes in range, their centres' angle, and the shards the node is in."""

    def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if nodes.num_rows and asked.num_rows:
            ids, x, r = nodes.column("id").to_numpy(), vs.matrix(nodes.column("v")), nodes.column("r").to_numpy()
            graph = Graph(x, _united(ids, nodes.column("links").combine_chunks()))
            who, q, own = asked.column("id").to_numpy(), vs.matrix(asked.column("v")), asked.column("r").to_numpy()
            for lo in range(0, len(who), BLOCK):
                part = slice(lo, lo + BLOCK)
                floor = np.cos(np.minimum(theta + own[part] + r.max(), np.pi))
                # single precision, and a margin for ways through nodes just out of range
                sims = graph.search(q[part].astype(np.float32), floor - 0.02, beam)
                i, j = np.nonzero(sims >= (floor - 1e-4)[:, None])
                d = angles(q[part][i], x[j])
                keep = (who[part][i] != ids[j]) & (d <= theta + own[part][i] + r[j] + SLACK)
                for out, v in zip(found, (who[part][i[keep]], ids[j[keep]], d[keep], j[keep]), strict=True):
                    out.append(v)
        a, b, d, j = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64()), nodes.column("cells").combine_chunks().take(pa.array(j, pa.int64()))], names=["a", "b", "d", "cells"])

    return run


def _deal(centres: vs.Centres, overlap: int):
    """Nodes with the ``overlap`` nearest shards, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            at, _ = centres.near(vs.matrix(rows.column("v")), min(overlap, len(centres)))
            r, c = np.nonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(r)) for k in ("id", "v", "r")), pa.array(at[r, c])], ["id", "v", "r", "cell"])

    return run


def _route(centres: vs.Centres, theta: float, widest: float, gap: float):
    """Nodes with the shards that they search: their own, and those beyond whose border they have a partner with fair odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            x, r = vs.matrix(rows.column("v")), rows.column("r").to_numpy()
            width = min(16, len(centres))
            while True:
                at, d = centres.near(x, width)
                apart = np.linalg.norm(centres.points[at] - centres.points[at[:, :1]], axis=2)
                border = (d**2 - d[:, :1] ** 2) / (2 * np.maximum(apart, 1e-12))
                reach = 2 * np.sin(np.minimum(theta + r + widest, np.pi) / 2) * gap / x.shape[1] ** 0.5
                goes = (at >= 0) & (border <= reach[:, None])
                goes[:, 0] = True
                if width == len(centres) or not goes[:, -1].any():
                    break
                width = min(4 * width, len(centres))
            i, c = np.nonzero(goes)
            yield pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(i)) for k in ("id", "v", "r")), pa.array(at[i, c])], ["id", "v", "r", "cell"])

    return run


def unit(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vs.clean(rows, id_col, vector).withColumn("len", length).filter("len > 0").select("id", F.transform("v", lambda x: x / F.col("len")).alias("v"))


def condensed(scratch: Scratch, every: DataFrame, n: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """(id, node) of all rows, and the nodes (id, v, r, m)."""
    drawn = vs.sample(every, n, vs.PER * max(1, n // CHUNK))
    # copies in the sample count once, so that a large group of them gets few centres
    distinct = [np.zeros((0, drawn.shape[1]))]
    for lo in range(0, len(drawn), CHUNK):
        x = drawn[lo : lo + CHUNK]
        owner, centres, _ = condense(x, np.zeros(len(x)), np.ones(len(x)), limit)
        distinct += [centres, x[owner < 0]]
    cells = vs.Centres.fit(np.concatenate(distinct), max(1, n // CHUNK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("v"), pa.array(cells.near(vs.matrix(rows.column("v")), 1)[0][:, 0])], ["id", "v", "cell"])

    homes = every.mapInArrow(deal, "id long, v array<double>, cell long").withColumns({"r": F.lit(0.0), "m": F.lit(1).cast("long")})
    parts = scratch.put(homes)
    members, rest = None, None
    while True:
        sizes = parts.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        chunks = F.pmod(F.xxhash64("id"), F.col("chunks"))
        step = scratch.put(parts.join(F.broadcast(sizes), "cell").withColumn("chunk", chunks).groupBy("cell", "chunk").applyInArrow(_condense(limit), NODE))
        own = step.select("id", "node")
        members = own if members is None else members.join(own.select(F.col("id").alias("node"), F.col("node").alias("over")), "node", "left").select("id", F.coalesce("over", "node").alias("node"))
        nodes = step.filter("id = node").select("id", "v", "r", "m")
        nodes = nodes if rest is None else nodes.unionByName(rest)
        # groups of cells that were cut to chunks are condensed again, as long as that makes them half as many
        again = step.filter("id = node and m > 1").join(parts.join(F.broadcast(sizes.filter("chunks > 1")), "cell").select("id", "cell"), "id").select("id", "v", "cell", "r", "m")
        again = scratch.put(again)
        left = again.count()
        if left < 2 or 2 * left > parts.count():
            return members, nodes
        rest = nodes.join(again.select("id"), "id", "left_anti")
        parts = again


def _brute(theta: float, ids: np.ndarray, x: np.ndarray, r: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            own, v, far = rows.column("id").to_numpy(), vs.matrix(rows.column("v")), rows.column("r").to_numpy()
            for lo in range(0, len(own), BLOCK):
                part = slice(lo, lo + BLOCK)
                i, j = np.nonzero(x @ v[part].T >= np.cos(np.minimum(theta + r[:, None] + far[part], np.pi)) - 1e-7)
                keep = (ids[i] != own[part][j]) & (angles(x[i], v[part][j]) <= theta + r[i] + far[part][j])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[keep]]), pa.array(own[part][j[keep]])], ["q", "other"])

    return run


def known_pairs(scratch: Scratch, nodes: DataFrame, theta: float) -> DataFrame:
    """(q, other) by brute force of as many rows as give AUDIT_PAIRS pairs, of AUDIT_ROWS at most."""
    size = 128
    while True:
        drawn = nodes.select("id", "v", "r", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(size).toArrow()
        found = scratch.put(nodes.select("id", "v", "r").mapInArrow(_brute(theta, drawn.column("id").to_numpy(), vs.matrix(drawn.column("v")), drawn.column("r").to_numpy()), "q long, other long"))
        if found.count() >= AUDIT_PAIRS or size >= AUDIT_ROWS or drawn.num_rows < size:
            return found
        size = min(8 * size, AUDIT_ROWS)


def node_pairs(scratch: Scratch, nodes: DataFrame, n: int, theta: float, gap: float, overlap: int, beam: int) -> DataFrame:
    """(a, b, d): pairs of nodes whose members may be near, and their centres' angle."""
    centres, _ = vs.centres_of(nodes, n, SHARD)
    widest = nodes.agg(F.max("r")).first()[0]
    dealt = nodes.select("id", "v", "r").mapInArrow(_deal(centres, overlap), "id long, v array<double>, r double, cell long")
    built = dealt.groupBy("cell").applyInArrow(_build, "id long, v array<double>, r double, cell long, links array<long>")
    united = built.groupBy("id").agg(F.first("v").alias("v"), F.first("r").alias("r"), F.collect_set("cell").alias("cells"), F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    region = scratch.put(united.withColumn("cell", F.explode("cells")))
    asked = scratch.put(nodes.select("id", "v", "r").mapInArrow(_route(centres, theta, widest, gap), "id long, v array<double>, r double, cell long"))
    seen, found = asked.select("id", "cell"), []
    while True:
        here = region if not found else region.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")  # at most as many as there are shards
        step = scratch.put(here.select("id", "v", "r", "links", "cells", "cell").groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(_search(theta, beam), "a long, b long, d double, cells array<long>"))
        found.append(step.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d"))
        # the search goes on in the other shards of what is in range
        on = step.select(F.col("a").alias("id"), F.explode("cells").alias("cell")).distinct().join(seen, ["id", "cell"], "left_anti")
        asked = scratch.put(on.join(nodes.select("id", "v", "r"), "id").select("id", "v", "r", "cell"))
        if asked.isEmpty():
            break
        seen = seen.unionByName(asked.select("id", "cell"))
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    return scratch.put(pairs.groupBy("a", "b").agg(F.min("d").alias("d")))


def _members(threshold: float):
    """(id, a, b, n) of one block of two nodes' members: how many of the other node's each is near to."""

    def run(table: pa.Table) -> pa.Table:
        ids, x, side = table.column("id").to_numpy(), vs.matrix(table.column("v")), table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = x[left] @ x[right].T >= threshold
        n = np.zeros(len(ids), np.int64)
        n[left], n[right] = near.sum(1), near.sum(0)
        some = np.flatnonzero(n)
        return pa.table([pa.array(ids[some]), *(table.column(k).take(pa.array(some)) for k in "ab"), pa.array(n[some])], names=["id", "a", "b", "n"])

    return run


def near_groups(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, class_id, n_links) of each row with a vector: the least id of its class of rows joined by links, and the rows within the threshold's cosine of it."""
    scratch = Scratch(spark, "graph")
    theta = float(np.arccos(threshold))
    every = scratch.put(unit(rows, id_col, vector))
    n = every.count()
    if not n:
        return spark.createDataFrame([], f"`{id_col}` long, class_id long, n_links long")
    members, nodes = condensed(scratch, every, n, theta / 2 - SLACK)
    members, nodes = scratch.put(members), scratch.put(nodes)
    n = nodes.count()
    truth = known_pairs(scratch, nodes, theta)
    gap, overlap, beam = GAP, OVERLAP, BEAM
    while True:
        pairs = node_pairs(scratch, nodes, n, theta, gap, overlap, beam)
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("hit", F.lit(1.0))
        recall = truth.join(both, (F.col("q") == F.col("a")) & (F.col("other") == F.col("b")), "left").groupBy("q").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r")).agg(F.avg("r")).first()[0]
        if recall is None:
            log.warning("No audited row has a partner: the recall of these pairs is not known.")
        if recall is None or recall >= RECALL or beam >= n:
            break
        gap, overlap, beam = 2 * gap, overlap + 1, 2 * beam
    size = nodes.select("id", "r", "m")
    known = pairs.join(size.select(F.col("id").alias("a"), F.col("r").alias("ra"), F.col("m").alias("ma")), "a").join(size.select(F.col("id").alias("b"), F.col("r").alias("rb"), F.col("m").alias("mb")), "b")
    known = scratch.put(known.withColumn("sure", F.col("d") + F.col("ra") + F.col("rb") <= F.lit(theta - SLACK)))
    sure = known.filter("sure")
    # members are compared in blocks of at most CHUNK a side
    blocks = known.filter("not sure").withColumns({"na": F.ceil(F.col("ma") / CHUNK).cast("long"), "nb": F.ceil(F.col("mb") / CHUNK).cast("long")})
    sides = []
    for side, (own, mine, others) in enumerate((("a", "na", "nb"), ("b", "nb", "na"))):
        here = blocks.select("a", "b", F.col(own).alias("node"), F.col(mine).alias("mine"), F.col(others).alias("others")).join(members, "node")
        part, other = F.pmod(F.xxhash64("id"), F.col("mine")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("y")
        here = here.select("id", "a", "b", part, other, F.lit(side).alias("side"))
        sides.append(here.select("id", "a", "b", *([F.col("x").alias("i"), F.col("y").alias("j")] if not side else [F.col("y").alias("i"), F.col("x").alias("j")]), "side"))
    compared = scratch.put(sides[0].unionByName(sides[1]).join(every, "id").groupBy("a", "b", "i", "j").applyInArrow(_members(threshold), "id long, a long, b long, n long"))
    roots = components(scratch, sure.select("a", "b").unionByName(compared.select("a", "b")))
    far = sure.select(F.col("a").alias("node"), F.col("mb").alias("n")).unionByName(sure.select(F.col("b").alias("node"), F.col("ma").alias("n"))).groupBy("node").agg(F.sum("n").alias("sure"))
    about = size.select(F.col("id").alias("node"), "m").join(far, "node", "left").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class_id"), (F.col("m") - 1 + F.coalesce("sure", F.lit(0))).alias("n"))
    own = compared.groupBy("id").agg(F.sum("n").alias("verified"))
    out = members.join(about, "node").join(own, "id", "left")
    return out.select(F.col("id").alias(id_col), "class_id", (F.col("n") + F.coalesce("verified", F.lit(0))).cast("long").alias("n_links"))
