"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to cells by norm and direction and cells to shards of a bounded size by hash. In a shard the distinct
vectors are ordered by norm, and each band of similar norms gets a graph with layers, built in
batches: a batch searches the graph so far in lockstep, candidates of the graph and of the batch itself are
thinned by the diversity rule, and back links are thinned in the same way. Layers are stored as flat
neighbour arrays beside ids and vectors, one row a shard, in the shared folder. Queries go in blocks to the shards of the most
promising cells, as many as a measured recall needs, walk through the bands from long vectors to short ones until these
can't win, and the shards' best are merged by rank.

Inside a band inner products become nearest neighbours by one more component that gives all vectors one length. Over all norms
that component would swamp the others: recall at 20 of 16,384 gaussian vectors of 64 dimensions whose lengths differ by up to a
factor of 8 was 0.50 with one graph and is 0.99 with bands.

Defined results: vectors that are null, zero, or hold null or non-finite components, rows with a null id, and vectors
whose length is not the most frequent one (the smaller of equally frequent) take no part; equal vectors share one
node of a shard and all count as candidates, ties go to the smaller id; a query never returns rows of its own id, and of repeated
queries with one id the one with the smallest vector asks; with
fewer candidates than k all found are returned; scores are products of the vectors as they are given, in double precision; an empty table
gives no rows; repeated rows are candidates each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cdrspark.llm.common import mixed, written

#: Vectors in a shard and queries in a block, about.
SHARD_ROWS, BLOCK_ROWS = 16384, 2048
#: The largest factor between norms in a band, and distinct vectors that a band has whatever their norms.
BAND, BAND_ROWS = 1.3, 512


@dataclass
class Layer:
    """nodes (sorted numbers of distinct vectors) and their neighbours (as numbers of vectors, -1: none)."""

    nodes: np.ndarray
    links: np.ndarray

    def rows(self, numbers: np.ndarray) -> np.ndarray:
        return numbers if len(self.nodes) and self.nodes[-1] == len(self.nodes) - 1 else np.searchsorted(self.nodes, numbers)


def beam(x: np.ndarray, layer: Layer, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `width` nodes of largest inner product that a best-first walk from its entry meets,
    best first (-1 where fewer), and the products; all queries step together."""
    count = len(q)
    ids = np.full((count, width), -1, np.int64)
    sims = np.full((count, width), -np.inf, np.float32)
    open_ = np.zeros((count, width), bool)
    met = np.zeros((count, len(layer.nodes)), bool)
    ids[:, 0], open_[:, 0] = entry, True
    sims[:, 0] = np.einsum("bd,bd->b", q, x[entry])
    met[np.arange(count), layer.rows(entry)] = True
    live = np.arange(count)
    while len(live):
        best = np.where(open_[live], sims[live], -np.inf).argmax(axis=1)
        more = open_[live, best]
        live, best = live[more], best[more]
        if not len(live):
            break
        open_[live, best] = False
        near = layer.links[layer.rows(ids[live, best])]
        at = layer.rows(np.maximum(near, layer.nodes[0]))
        fresh = (near >= 0) & ~met[live[:, None], at]
        met[np.broadcast_to(live[:, None], at.shape)[fresh], at[fresh]] = True
        found = np.einsum("bmd,bd->bm", x[np.where(fresh, near, 0)], q[live])
        found[~fresh] = -np.inf
        all_sims = np.concatenate([sims[live], found], axis=1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live] = np.take_along_axis(all_sims, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), keep, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    ids[np.isneginf(sims)] = -1
    return ids, sims


def thinned(x: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) up to `most`: those nearer to the row's own vector than
    to any kept one, then the best of the others."""
    rows, width = near.shape
    v = x[np.maximum(near, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((rows, width), bool)
    real = near >= 0
    for j in range(width):
        closest = np.where(kept[:, :j], between[:, j, :j], -np.inf).max(axis=1, initial=-np.inf)
        kept[:, j] = real[:, j] & (closest < sims[:, j]) & (kept[:, :j].sum(axis=1) < most)
    order = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(near, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def best_first(near: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by product, repeated candidates only once."""
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    by_id = np.argsort(near, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(near, by_id, 1)
    again = np.zeros(near.shape, bool)
    np.put_along_axis(again, by_id[:, 1:], (sorted_ids[:, 1:] == sorted_ids[:, :-1]) & (sorted_ids[:, 1:] >= 0), 1)
    near, sims = np.where(again, -1, near), np.where(again, -np.inf, sims)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """The layers of one band, highest first; every layer's entry is the first node of the highest."""

    def __init__(self, x: np.ndarray, layers: list[Layer]):
        self.x, self.layers = x, layers

    def entries(self, q: np.ndarray, down_to: int) -> np.ndarray:
        """Where to enter layer number down_to: the nearest nodes of the layers above."""
        at = np.full(len(q), self.layers[0].nodes[0])
        for layer in self.layers[:down_to]:
            at = beam(self.x, layer, q, at, 1)[0][:, 0]
        return at

    def search(self, q: np.ndarray, width: int, together: int = 256) -> np.ndarray:
        out = [beam(self.x, self.layers[-1], q[i : i + together], self.entries(q[i : i + together], len(self.layers) - 1), width)[0] for i in range(0, len(q), together)]
        return np.concatenate(out) if out else np.zeros((0, width), np.int64)


def build(x: np.ndarray, seeds: np.ndarray, links: int = 16, width: int = 64, batch: int = 512) -> Graph:
    """A graph over x (rows of equal norm). seeds: a 64-bit hash of each row, for its level and its turn."""
    level = np.floor(-np.log((mixed(seeds, 1).astype(np.float64) + 1) / 2.0**64) / math.log(links)).astype(int)
    turn = np.lexsort((mixed(seeds, 2), -level))
    graph = Graph(x, [])
    for k in range(int(level.max()), -1, -1):
        inside = turn[level[turn] >= k]
        most = 2 * links if k == 0 else links
        nodes = np.sort(inside)
        layer = Layer(nodes, np.full((len(nodes), most), -1, np.int64))
        graph.layers.append(layer)
        done = 0
        while done < len(inside):
            # The first nodes only see each other; then batches no larger than what is there.
            new = inside[done : done + max(1, min(batch, done or 32))]
            among = x[new] @ x[new].T
            np.fill_diagonal(among, -np.inf)
            top = min(links, len(new))
            own = np.argpartition(-among, top - 1, axis=1)[:, :top]
            near, sims = new[own], np.take_along_axis(among, own, 1)
            near = np.where(np.isneginf(sims), -1, near)
            if done:
                start = np.full(len(new), inside[0]) if len(graph.layers) == 1 else graph.entries(x[new], len(graph.layers) - 1)
                met, met_sims = beam(x, layer, x[new], start, width)
                near, sims = np.concatenate([near, met], axis=1), np.concatenate([sims, met_sims], axis=1)
            near, sims = best_first(near, sims)
            chosen = thinned(x, near, sims, links)
            layer.links[layer.rows(new), :links] = chosen
            _link_back(x, layer, new, chosen, most)
            done += len(new)
    return graph


def _link_back(x: np.ndarray, layer: Layer, new: np.ndarray, chosen: np.ndarray, most: int) -> None:
    """Links from the chosen nodes to the new ones; full lists are thinned again."""
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    if not len(target):
        return
    sim = np.einsum("nd,nd->n", x[source], x[target])
    order = np.lexsort((-sim, target))
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, count)
    for part in np.array_split(np.arange(len(nodes)), -(-len(nodes) // 512)):
        mine = np.repeat(np.isin(np.arange(len(nodes)), part), count)
        wide = np.full((len(part), int(count[part].max())), -1, np.int64)
        wide[np.searchsorted(part, np.repeat(np.arange(len(nodes)), count)[mine]), rank[mine]] = source[mine]
        near = np.concatenate([layer.links[layer.rows(nodes[part])], wide], axis=1)
        sims = np.einsum("bmd,bd->bm", x[np.maximum(near, 0)], x[nodes[part]])
        sims[near < 0] = -np.inf
        near, sims = best_first(near, sims)
        room = min(near.shape[1], 2 * most)
        layer.links[layer.rows(nodes[part])] = thinned(x, near[:, :room], sims[:, :room], most)


# -- shards as rows -------------------------------------------------------------------------


def norms_of(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow on the way."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top, 1.0)
    return top * np.sqrt(((x / scale[:, None]) ** 2).sum(axis=1))


def bands(norms: np.ndarray) -> list[int]:
    """Where the bands of falling norms begin, and the end: a band's norms differ by a factor of BAND at most, but for bands of
    fewer than BAND_ROWS."""
    out, at = [], 0
    while at < len(norms):
        out.append(at)
        at = max(int(np.searchsorted(-norms, -norms[at] / BAND, side="right")), min(len(norms), at + BAND_ROWS))
    return [*out, len(norms)]


def _wide(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of one band, the longest with length 1, with a component that gives them all that length."""
    part = norms / norms[0]
    unit = x.astype(np.float64) / norms[:, None] * part[:, None]
    return np.concatenate([unit, np.sqrt(np.maximum(1 - part**2, 0))[:, None]], axis=1).astype(np.float32)


def pack(ids: np.ndarray, vectors: np.ndarray, links: int, width: int) -> dict[str, bytes]:
    """One shard: rows' ids, which node each has, the distinct vectors by falling norm, and each band's layers as flat arrays."""
    vectors = np.ascontiguousarray(vectors)
    x, node_of = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel(), return_inverse=True)
    x = x.view(vectors.dtype).reshape(-1, vectors.shape[1])
    norms = norms_of(x)
    fall = np.argsort(-norms, kind="stable")
    x, norms = x[fall], norms[fall]
    back = np.empty(len(fall), np.int64)
    back[fall] = np.arange(len(fall))
    node_of = back[node_of.ravel()]
    order = np.lexsort((ids, node_of))
    edges = bands(norms)
    graphs = [build(_wide(x[lo:hi], norms[lo:hi]), mixed(np.arange(lo, hi, dtype=np.uint64), 7), links, width) for lo, hi in zip(edges, edges[1:], strict=False)]
    layers = [layer for g in graphs for layer in g.layers]
    return {
        "ids": ids[order].astype(np.int64).tobytes(),
        "node_of": node_of[order].astype(np.int32).tobytes(),
        "vectors": x.tobytes(),
        "edges": np.array(edges, np.int64).tobytes(),
        "layers": np.array([len(g.layers) for g in graphs], np.int64).tobytes(),
        "sizes": np.array([len(layer.nodes) for layer in layers], np.int64).tobytes(),
        "nodes": np.concatenate([layer.nodes for layer in layers]).astype(np.int32).tobytes(),
        "links": np.concatenate([layer.links.ravel() for layer in layers]).astype(np.int32).tobytes(),
    }


@dataclass
class Shard:
    """A shard as it is searched: ids by node, where each node's ids begin, the distinct vectors, norms, and a graph a band."""

    ids: np.ndarray
    begin: np.ndarray
    x: np.ndarray
    norms: np.ndarray
    edges: list[int]
    graphs: list[Graph]


def unpack(row: dict, dim: int, links: int, kind: type) -> Shard:
    long = lambda name: np.frombuffer(row[name], np.int64)
    ids, node_of = long("ids"), np.frombuffer(row["node_of"], np.int32)
    x = np.frombuffer(row["vectors"], kind).reshape(-1, dim)
    nodes, flat = np.frombuffer(row["nodes"], np.int32).astype(np.int64), np.frombuffer(row["links"], np.int32).astype(np.int64)
    norms, edges, sizes = norms_of(x), long("edges").tolist(), iter(long("sizes").tolist())
    graphs, at, link_at = [], 0, 0
    for lo, hi, count in zip(edges, edges[1:], long("layers").tolist(), strict=False):
        layers = []
        for k in range(count):
            n, most = next(sizes), 2 * links if k == count - 1 else links
            layers.append(Layer(nodes[at : at + n], flat[link_at : link_at + n * most].reshape(n, most)))
            at, link_at = at + n, link_at + n * most
        graphs.append(Graph(_wide(x[lo:hi], norms[lo:hi]), layers))
    return Shard(ids, np.searchsorted(node_of, np.arange(len(x) + 1)), x, norms, edges, graphs)


def best_nodes(shard: Shard, q: np.ndarray, most: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `most` nodes of largest exact product that its walks through the bands meet (-1 where fewer), ties
    to the smaller first id. A band whose longest vector can't reach the worst of them is left out."""
    count = len(q)
    nodes, scores = np.full((count, most), -1, np.int64), np.full((count, most), -np.inf)
    length = norms_of(q)
    unit = np.concatenate([q / np.where(length > 0, length, 1.0)[:, None], np.zeros((count, 1))], axis=1).astype(np.float32)
    first = np.append(shard.ids[shard.begin[:-1]], 2**63 - 1)  # node -1 comes last
    for lo, graph in zip(shard.edges, shard.graphs, strict=False):
        live = np.flatnonzero(length * shard.norms[lo] * (1 + 1e-9) >= scores[:, -1])
        if not len(live):
            break
        near = graph.search(unit[live], min(width, len(graph.x)))
        near = np.where(near >= 0, near + lo, -1)
        found = (shard.x[np.maximum(near, 0)].astype(np.float64) * q[live][:, None]).sum(axis=2)
        found[near < 0] = -np.inf
        near, found = np.concatenate([nodes[live], near], axis=1), np.concatenate([scores[live], found], axis=1)
        order = np.lexsort((first[near], -found), axis=1)[:, :most]
        nodes[live], scores[live] = np.take_along_axis(near, order, 1), np.take_along_axis(found, order, 1)
    return nodes, scores


def shard_best(shard: Shard, q_ids: np.ndarray, q: np.ndarray, k: int, width: int, together: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard each query's k best rows but those of its own id: query ids, row ids, exact scores."""
    out: list[tuple[int, int, float]] = []
    for at in range(0, len(q), together):
        part = q[at : at + together].astype(np.float64)
        # One node more: its own may hold its own row alone.
        nodes, scores = best_nodes(shard, part, k + 1, max(width, k + 1))
        for query, near, score in zip(q_ids[at : at + together].tolist(), nodes.tolist(), scores.tolist(), strict=True):
            rows = [(-s, r) for n, s in zip(near, score, strict=True) if n >= 0 for r in _few(shard.ids[shard.begin[n] : shard.begin[n + 1]], query, k)]
            out += [(query, r, -s) for s, r in sorted(rows)[:k]]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, c = zip(*out, strict=True)
    return np.array(a), np.array(b), np.array(c)


def _few(sorted_ids: np.ndarray, query: int, k: int) -> list[int]:
    """The k smallest of sorted ids but for the query's own, which may be repeated."""
    lo, hi = np.searchsorted(sorted_ids, [query, query + 1])
    return np.concatenate([sorted_ids[:lo][:k], sorted_ids[hi:][:k]])[:k].tolist()


# -- tables ---------------------------------------------------------------------------------


def usable(table: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding (float stays float, all other numbers are double) of the rows that take part, and the vectors' length."""
    kind = "array<float>" if dict(table.dtypes)["embedding"] == "array<float>" else "array<double>"
    e = F.col("embedding")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(kind).alias("embedding")).filter(F.col("vec_id").isNotNull() & e.isNotNull())
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.filter(~F.exists(e, bad) & F.exists(e, lambda v: v != 0))
    top = rows.groupBy(F.size(e).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = top[0]["d"] if top else 0
    return rows.filter(F.size("embedding") == dim), dim


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


PACKED = ("ids", "node_of", "vectors", "edges", "layers", "sizes", "nodes", "links")


@dataclass
class Index:
    """Graphs, one row a shard, in the shared folder; and what queries are routed by: of each cell the direction of its centre (zero:
    none), its largest norm, and the number of its first shard (one more: of all shards)."""

    graphs: DataFrame
    centres: np.ndarray
    top: np.ndarray
    first: np.ndarray
    dim: int
    links: int
    kind: type


def centres_of(unit: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Directions of `count` groups of unit vectors, by spherical means that start at rows far from each other."""
    chosen = [0]
    near = unit @ unit[0]
    for _ in range(1, count):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, of, unit)
        size = np.sqrt((total**2).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
    return centres


def index(rows: DataFrame, dim: int, shard_rows: int = SHARD_ROWS, sample_rows: int = 16_384, links: int = 16, width: int = 64) -> Index:
    """Deals rows to cells by norm band and direction, cells to shards of about shard_rows by hash, and builds the shards' graphs.

    Bands of a factor BAND in norm that are small share a cell with the next ones. In a band of several shards directions are
    grouped around centres that are fitted on a sample (sample_rows by hash over all bands, 32 for each centre at least)."""
    kind = np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64
    vector = rows.schema["embedding"].dataType.simpleString()

    def with_band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = norms_of(_matrix(batch.column("embedding"), dim)) if batch.num_rows else np.ones(0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(np.floor(np.log(norm) / math.log(BAND)), pa.int32())], names=["vec_id", "embedding", "band"])

    banded = written(rows.select("vec_id", "embedding").mapInArrow(with_band, f"vec_id long, embedding {vector}, band int"), "ann-rows")
    # The range of doubles has fewer than 6,000 bands.
    sizes = sorted(((r["band"], r["n"]) for r in banded.groupBy("band").agg(F.count("*").alias("n")).collect()), reverse=True)
    total, groups = sum(n for _, n in sizes), []
    for b, n in sizes:
        if groups and groups[-1][1] + n <= shard_rows:
            groups[-1][0].append(b)
            groups[-1][1] += n
        else:
            groups.append([[b], n])
    want = {b: -(-n // shard_rows) for (b, *_), n in groups if n > shard_rows}
    sampled: dict[int, list] = {b: [] for b in want}
    if want:
        share = min(1.0, sample_rows / total)
        some = banded.filter(F.col("band").isin(*want) & (F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(2**30)) < int(share * 2**30)))
        for r in some.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(2 * sample_rows).toLocalIterator():
            sampled[r["band"]].append(np.array(r["embedding"], np.float64))
    centres, cell_of = [], {}
    for group, _ in groups:
        count = min(want.get(group[0], 1), max(1, len(sampled.get(group[0], ())) // 32))
        for b in group:
            cell_of[b] = (len(centres), count)
        if count > 1:
            x = np.array(sampled[group[0]])
            centres += list(centres_of((x / norms_of(x)[:, None]).astype(np.float32), count))
        else:
            centres.append(np.zeros(dim, np.float32))
    centres = np.array(centres, np.float32).reshape(len(centres), dim)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                x = _matrix(piece.column("embedding"), dim).astype(np.float64)
                norm = norms_of(x)
                first, count = np.array([cell_of[b] for b in piece.column("band").to_pylist()], np.int64).T
                cell = first.copy()
                for c, n in {(int(c), int(n)) for c, n in zip(first, count, strict=True) if n > 1}:
                    mine = first == c
                    cell[mine] += ((x[mine] / norm[mine, None]).astype(np.float32) @ centres[c : c + n].T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("embedding"), pa.array(cell, pa.int32()), pa.array(norm)], names=["vec_id", "embedding", "cell", "norm"])

    dealt = written(banded.mapInArrow(deal, f"vec_id long, embedding {vector}, cell int, norm double"), "ann-cells")
    counts = {r["cell"]: (r["n"], r["top"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    shards = [-(-counts.get(c, (0, 0))[0] // shard_rows) for c in range(len(centres))]
    first = np.concatenate([[0], np.cumsum(shards)]).astype(np.int64)
    top = np.array([counts.get(c, (0, 0.0))[1] for c in range(len(centres))], np.float64)
    # One row a cell.
    spark = rows.sparkSession
    table = spark.createDataFrame([(c, int(first[c]), int(n)) for c, n in enumerate(shards) if n], "cell int, first int, shards int")
    placed = dealt.join(F.broadcast(table), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shards"))).cast("int"))

    def one(part: pa.Table) -> pa.Table:
        packed = pack(part.column("vec_id").to_numpy(), _matrix(part.column("embedding"), dim), links, width)
        return pa.table({"shard": pa.array([part.column("shard")[0].as_py()], pa.int32()), **{k: pa.array([packed[k]], pa.binary()) for k in PACKED}})

    graphs = written(placed.select("shard", "vec_id", "embedding").groupBy("shard").applyInArrow(one, "shard int, " + ", ".join(f"{k} binary" for k in PACKED)), "hnsw")
    return Index(graphs, centres, top, first, dim, links, kind)


def _routed(found: Index, queries: DataFrame, cells: int | None) -> DataFrame:
    """vec_id, embedding, place, shard: each query with the shards of the `cells` most promising cells (None: of all), by the product
    of a cell's largest norm and the direction of its centre."""
    centres, top, first, dim = found.centres, found.top, found.first, found.dim
    loose = ~centres.any(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                x = _matrix(piece.column("embedding"), dim).astype(np.float64)
                cosine = (x / norms_of(x)[:, None]) @ centres.T.astype(np.float64)
                cosine[:, loose] = 1.0
                order = np.argsort(-cosine * top, axis=1, kind="stable")[:, :cells]
                counts = (first[1:] - first[:-1])[order]
                row, place = np.repeat(np.indices(order.shape).reshape(2, -1), counts.ravel(), axis=1)
                start = np.cumsum(counts.ravel()) - counts.ravel()
                shard = np.repeat(first[order.ravel()] - start, counts.ravel()) + np.arange(len(row))
                for lo in range(0, len(row), 4096):
                    part = slice(lo, lo + 4096)
                    take = pa.array(row[part])
                    yield pa.RecordBatch.from_arrays([piece.column("vec_id").take(take), piece.column("embedding").take(take), pa.array(place[part], pa.int32()), pa.array(shard[part], pa.int32())], names=["vec_id", "embedding", "place", "shard"])

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, embedding {kind}, place int, shard int")


def _asked(found: Index, routed: DataFrame, k: int, width: int) -> DataFrame:
    """query_id, vec_id, score, place, rank: the k best of each query over the shards that it is routed to."""
    routed = written(routed, "ann-routed")
    counts = routed.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    counts = written(counts, "ann-blocks")
    # A graph goes to each block of its shard's queries, so neither a task's queries nor its graphs grow.
    graphs = found.graphs.join(counts, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = routed.join(counts, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks")).cast("int")).drop("blocks")
    dim, links, kind = found.dim, found.links, found.kind
    names = ["query_id", "vec_id", "score", "place"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32()]

    def search_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        shard = unpack({c: right.column(c)[0].as_py() for c in PACKED}, dim, links, kind)
        ids = left.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        place = left.column("place").to_numpy()[order]
        a, b, c = shard_best(shard, ids[order], _matrix(left.column("embedding"), dim)[order], k, width)
        return pa.table([pa.array(a, kinds[0]), pa.array(b, kinds[1]), pa.array(c, kinds[2]), pa.array(place[np.searchsorted(ids[order], a)], kinds[3])], names=names)

    best = asked.groupBy("shard", "block").cogroup(graphs.groupBy("shard", "block")).applyInArrow(search_block, "query_id long, vec_id long, score double, place int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cells_needed(found: Index, queries: DataFrame, k: int, width: int, recall: float, probes: int) -> int:
    """How many cells a query must ask for this share of what all cells give, measured on `probes` queries (the first by hash)."""
    some = queries.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(probes)
    places = np.array([r["place"] for r in _asked(found, _routed(found, some, None), k, width).select("place").collect()], np.int64)
    if not len(places):
        return len(found.centres)
    share = np.cumsum(np.bincount(places, minlength=len(found.centres))) / len(places)
    return int(np.searchsorted(share, recall)) + 1


def search(found: Index, queries: DataFrame, k: int = 20, width: int = 192, recall: float | None = 0.99, probes: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of each row of queries (vec_id, embedding; different ids).

    Queries ask as many cells as `recall` of the results needs, as measured on `probes` of them; with recall None, all."""
    cells = cells_needed(found, queries, k, width, recall, probes) if recall is not None and len(found.centres) > 1 else None
    return _asked(found, _routed(found, queries, cells), k, width).select("query_id", "rank", "vec_id", "score")


def op5_hnsw_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dim = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = rows.filter(F.col("vec_id") % 20 == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return search(index(rows, dim), queries)
