"""Similarity joins on CDR3 sequences by lossless segment keys and an Arrow kernel.

A distance within the budget leaves few positions with a cost, so if both sequences are cut into one segment more,
some segment costs nothing. Residues that match at no cost have exactly one block in common (BLOCKS_OF), so both sides emit
their segments spelt in all blocks of their residues, and an equi-join on (lengths, segment number, text) finds each free segment
of a pair once. With a gap the segments of the shorter sequence lie in the longer one at offset 0 or 1, but for the one that
holds the gap. The kernel keeps a pair at its first free segment only, so no distinct is needed, and computes the distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdrspark.functions.constants import GAP_COST, HEAVY_WEIGHT, LENGTH_DIFF, LIGHT_WEIGHT, MAX_DISTANCE, MIN_CDR3
from cdrspark.functions.costs import BLOCKS_OF, COSTS, PLAIN, distances, position_costs
from cdrspark.operators.filters import with_order
from cdrspark.operators.tables import written

EDGE_SCHEMA = "seq_id_1 string, seq_id_2 string, cdr3_1 string, cdr3_2 string, distance double, chain string"
SCORINGS = ("weighted", "hamming")


def _segments(length: int, count: int) -> list[tuple[int, int]]:
    return [(length * i // count, length * (i + 1) // count) for i in range(count)]


def _counts(budget: float, least: float) -> tuple[int, int]:
    """Segments for pairs of equal length, and for pairs with a gap (0: none is in the budget)."""
    with_gap = budget - GAP_COST
    return int(budget / least) + 1, int(with_gap / least) + 2 if with_gap >= 0 else 0


#: Letters of a segment at most: a segment has up to 3 to this power spellings, however small the budget.
SEGMENT = 7


def _cut(least: int, length: int) -> int:
    """Segments of a sequence: no fewer than `least`, none longer than SEGMENT. More only make more of them free."""
    return max(least, -(-length // SEGMENT))


@lru_cache(maxsize=1000)
def _spelt(text: str, raw: bool) -> list[str]:
    blocks = BLOCKS_OF[0 if raw else 1]
    return ["".join(x) for x in itertools.product(*[blocks.get(c, c) for c in text])]


def segment_keys(seq: str, budget: float, scoring: str, length_diff: int, raw: bool, kinds: str = "EG") -> list[str]:
    """The keys of one sequence, as the first of a pair (raw) or as the second."""
    weighted = scoring == "weighted"
    equal, gap = _counts(budget, 0.5 if weighted else 1.0)
    n, keys = len(seq), []
    if "E" in kinds:
        if n < equal:
            keys.append(f"E{n}")
        else:
            for i, (lo, hi) in enumerate(_segments(n, _cut(equal, n))):
                keys += [f"E{n}:{i}:{v}" for v in (_spelt(seq[lo:hi], raw) if weighted else [seq[lo:hi]])]
    if "G" in kinds and weighted and gap and length_diff >= 1:
        short = n if raw else n - 1
        if 0 <= short < gap:
            keys.append(f"G{short}")
        elif short >= gap:
            for i, (lo, hi) in enumerate(_segments(short, _cut(gap, short))):
                for shift in (0, 1):
                    text = seq[lo:hi] if raw else seq[lo + shift : hi + shift]
                    keys += [f"G{short}:{2 * i + shift}:{v}" for v in _spelt(text, raw)]
    return keys


def with_keys(df: DataFrame, column: str, budget: float, scoring: str, length_diff: int, raw: bool, kinds: str = "EG") -> DataFrame:
    """A row of df for each key of its column. A sequence has up to some hundred keys, so few bytes of them are much work:
    they are dealt to all cores, whatever number of parts their size alone would give."""
    schema = T.StructType([*df.schema, T.StructField("key", T.StringType())])
    df = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = [segment_keys(s, budget, scoring, length_diff, raw, kinds) for s in part.column(column).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([c.take(rows) for c in part.columns] + [pa.array([k for own in keys for k in own], pa.string())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def first_free(kind: str, a: pa.Array, b: pa.Array, count: int, table: np.ndarray) -> np.ndarray:
    """The first segment of each pair that costs nothing (a: the shorter, all of one length; count: segments at least), with a gap
    twice the segment and the offset; -1: too short to have segments."""
    length = len(a[0].as_py())
    if length < count:
        return np.full(len(a), -1)
    total = [np.pad(np.cumsum(position_costs(a, b, s, table)[0], axis=1), ((0, 0), (1, 0))) for s in ((0,) if kind == "E" else (0, 1))]
    free = np.stack([t[:, hi] == t[:, lo] for lo, hi in _segments(length, _cut(count, length)) for t in total], axis=1)
    return np.where(free.any(axis=1), free.argmax(axis=1), free.shape[1])


def _kept(key: pa.Array, a: pa.Array, b: pa.Array, budget: float, scoring: str) -> tuple[np.ndarray, np.ndarray]:
    """Which candidate pairs count here, and the distances of all."""
    table = COSTS if scoring == "weighted" else PLAIN
    equal, gap = _counts(budget, 0.5 if scoring == "weighted" else 1.0)
    found = distances(a, b, table)
    keep = found <= budget + 1e-9
    at = np.flatnonzero(keep)
    groups: dict[tuple[str, int], list[int]] = {}
    texts = key.take(pa.array(at)).to_pylist()
    lengths = np.diff(np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1])
    for i, k in zip(at.tolist(), texts, strict=True):
        groups.setdefault((k[0], int(lengths[i])), []).append(i)
    number = {i: int(k.split(":", 2)[1]) if ":" in k else -1 for i, k in zip(at.tolist(), texts, strict=True)}
    for (kind, _), rows in groups.items():
        take = pa.array(rows)
        first = first_free(kind, a.take(take), b.take(take), equal if kind == "E" else gap, table)
        keep[rows] = first == np.array([number[i] for i in rows])
    return keep, found


def _joined(raw: DataFrame, expanded: DataFrame, condition: Column | None, a: str, b: str, budget: float, scoring: str, keep_columns: list[str], deal: int = 0) -> DataFrame:
    """Pairs within the budget, with keep_columns of the join and distance. With deal the rows of a key are dealt to so many keys
    (the other side goes to all of them) and the keys to all cores; without it that is left to adaptive execution."""
    if deal:
        parts = max(4 * raw.sparkSession.sparkContext.defaultParallelism, int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        raw = raw.withColumn("deal", F.pmod(F.xxhash64(a), F.lit(deal))).repartition(parts, "key", "deal")
        expanded = expanded.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long")))).repartition(parts, "key", "deal")
    on = raw["key"] == expanded["key"]
    on = on & (raw["deal"] == expanded["deal"]) if deal else on
    # Spark takes the keys of a sequence for no more bytes than the sequence, and would send millions of them through the driver.
    both = raw.hint("merge").join(expanded, on & condition if condition is not None else on).select(raw["key"].alias("key"), *[F.col(c) for c in keep_columns])
    schema = T.StructType([both.schema[c] for c in keep_columns] + [T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep, found = _kept(batch.column("key"), batch.column(a), batch.column(b), budget, scoring)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in keep_columns] + [pa.array(found[keep])], names=schema.fieldNames())

    return both.mapInArrow(run, schema)


def similar_pairs(seqs: DataFrame, budget: float, scoring: str = "weighted", length_diff: int = LENGTH_DIFF, deal: int = 0) -> DataFrame:
    """Self-join of (ord, seq_id, seq): ord_1, seq_id_1, seq_1, ord_2, seq_id_2, seq_2, distance with ord_1 < ord_2."""
    own = seqs.select("ord", "seq_id", "seq")
    a = with_keys(own.toDF("ord_a", "id_a", "seq_a"), "seq_a", budget, scoring, length_diff, raw=True)
    b = with_keys(own.toDF("ord_b", "id_b", "seq_b"), "seq_b", budget, scoring, length_diff, raw=False)
    once = (F.col("ord_a") < F.col("ord_b")) | (F.length("seq_a") < F.length("seq_b"))
    pairs = _joined(a, b, once, "seq_a", "seq_b", budget, scoring, ["ord_a", "id_a", "seq_a", "ord_b", "id_b", "seq_b"], deal)
    in_order = F.col("ord_a") < F.col("ord_b")
    pick = lambda x, y, n: F.when(in_order, F.col(x)).otherwise(F.col(y)).alias(n)
    return pairs.select(
        pick("ord_a", "ord_b", "ord_1"), pick("id_a", "id_b", "seq_id_1"), pick("seq_a", "seq_b", "seq_1"),
        pick("ord_b", "ord_a", "ord_2"), pick("id_b", "id_a", "seq_id_2"), pick("seq_b", "seq_a", "seq_2"), "distance",
    )


def similar_between(left: DataFrame, right: DataFrame, budget: float, length_diff: int = LENGTH_DIFF) -> DataFrame:
    """Weighted join of left (l_seq) and right (r_seq), each with columns of their own: all columns and distance."""
    columns = [*left.columns, *right.columns]
    straight = _joined(with_keys(left, "l_seq", budget, "weighted", length_diff, True), with_keys(right, "r_seq", budget, "weighted", length_diff, False), None, "l_seq", "r_seq", budget, "weighted", columns)
    other = _joined(with_keys(right, "r_seq", budget, "weighted", length_diff, True, "G"), with_keys(left, "l_seq", budget, "weighted", length_diff, False, "G"), None, "r_seq", "l_seq", budget, "weighted", columns)
    return straight.unionByName(other)


def global_edges(contigs: DataFrame, max_dist: float = MAX_DISTANCE, length_diff: int = LENGTH_DIFF, chain: str = "heavy", scoring: str = "weighted", subsample: int | None = None, seed: int = 1, reference_multiplicity: bool = False, deal: int = 0) -> DataFrame:
    """Edges between cells whose CDR3s are similar: one cell (the first) stands for each different CDR3.

    Weighted edges may have distance 0, Hamming edges not. With reference_multiplicity an edge is repeated
    for each length window that holds both sequences."""
    if chain == "paired":
        return paired_edges(contigs, max_dist, length_diff, subsample, seed)
    if scoring not in SCORINGS:
        raise ValueError(f"scoring is one of {SCORINGS}")
    rows = with_order(contigs).filter((F.col("chain_type") == chain) & (F.length("cdr3_aa") >= MIN_CDR3))
    seqs = rows.groupBy(F.col("cdr3_aa").alias("seq")).agg(F.min(F.struct("ord", F.col("cell_id").alias("seq_id"))).alias("first"))
    seqs = seqs.select("first.ord", "first.seq_id", "seq")
    if subsample is not None:
        seqs = seqs.orderBy(F.xxhash64("seq", F.lit(seed)), "seq").limit(subsample)
    pairs = similar_pairs(seqs, max_dist, scoring, length_diff, deal)
    if scoring == "hamming":
        pairs = pairs.filter("distance > 0")
    if reference_multiplicity:
        lengths = seqs.select(F.length("seq").alias("window")).distinct()
        low, high = F.least(F.length("seq_1"), F.length("seq_2")), F.greatest(F.length("seq_1"), F.length("seq_2"))
        pairs = pairs.withColumn("window", F.explode(F.sequence(high - length_diff, low))).join(lengths, "window").drop("window")
    return pairs.select("seq_id_1", "seq_id_2", F.col("seq_1").alias("cdr3_1"), F.col("seq_2").alias("cdr3_2"), "distance", F.lit(chain).alias("chain"))


def paired_edges(contigs: DataFrame, max_dist: float = MAX_DISTANCE, length_diff: int = LENGTH_DIFF, subsample: int | None = None, seed: int = 1) -> DataFrame:
    """Edges on 0.7 of the heavy plus 0.3 of the light weighted distance, over all pairs of heavy and light contigs of a cell.

    The heavy distance alone must be within the budget divided by its weight: different heavy CDR3s are joined by their keys, and
    only the cells of near ones are compared, different light CDR3s once."""
    rows = with_order(contigs).filter(F.col("cdr3_aa").isNotNull())
    heavy = rows.filter("chain_type = 'heavy'").select("cell_id", F.col("ord").alias("oh"), F.col("cdr3_aa").alias("h"))
    light = rows.filter("chain_type = 'light'").select("cell_id", F.col("ord").alias("ol"), F.col("cdr3_aa").alias("l"))
    cells = heavy.join(light, "cell_id").select(F.struct("oh", "ol").alias("ord"), F.col("cell_id").alias("seq_id"), "h", "l")
    if subsample is not None:
        cells = cells.orderBy(F.xxhash64("seq_id", F.lit(seed)), "ord").limit(subsample)
    cells = cells.select("ord.oh", "ord.ol", "seq_id", "h", "l")
    heavies = cells.groupBy("h").agg(F.count("*").alias("n"))
    seqs = heavies.select(F.col("h").alias("ord"), F.lit(None).cast("string").alias("seq_id"), F.col("h").alias("seq"))
    near = similar_pairs(seqs, max_dist / HEAVY_WEIGHT, "weighted", length_diff).select(F.col("seq_1").alias("h_a"), F.col("seq_2").alias("h_b"), F.col("distance").alias("heavy"))
    near = near.unionByName(heavies.select(F.col("h").alias("h_a"), F.col("h").alias("h_b"), F.lit(0.0).alias("heavy")))
    # Cells of one heavy CDR3 in blocks, so that a frequent one is many rows.
    block = F.pmod(F.xxhash64("seq_id", "oh", "ol"), F.ceil(F.col("n") / BLOCK))
    blocks = written(cells.join(heavies, "h").groupBy("h", block.alias("block")).agg(F.collect_list(F.struct("oh", "ol", "seq_id", "l")).alias("cells")), "blocks")
    both = near.join(blocks.toDF("h_a", "block_a", "a"), "h_a").join(blocks.toDF("h_b", "block_b", "b"), "h_b").filter("h_a <> h_b or block_a <= block_b")
    both = both.select("h_a", "h_b", "heavy", ((F.col("h_a") == F.col("h_b")) & (F.col("block_a") == F.col("block_b"))).alias("same"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _paired(batch, max_dist, length_diff)

    return both.mapInArrow(run, EDGE_SCHEMA)


#: Cells of a block, about; and pairs of cells that are compared at once.
BLOCK, PAIRS = 256, 300_000


def _light_distances(texts: pa.Array, x: np.ndarray, y: np.ndarray, length_diff: int) -> np.ndarray:
    """Weighted distances of texts[x] and texts[y], infinite where lengths differ by more: each different pair once."""
    codes, back = np.unique(x.astype(np.int64) * len(texts) + y, return_inverse=True)
    a, b = codes // len(texts), codes % len(texts)
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    found = distances(texts.take(pa.array(a)), texts.take(pa.array(b)))
    return np.where(np.abs(lengths[a] - lengths[b]) <= length_diff, found, np.inf)[back]


def _paired(batch: pa.RecordBatch, max_dist: float, length_diff: int) -> Iterator[pa.RecordBatch]:
    """Edges between the cells of two blocks (a, b; above the diagonal where they are the same)."""
    lists = [batch.column(c) for c in ("a", "b")]
    sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    flat = [x.flatten() for x in lists]
    begins = [np.cumsum(n) - n for n in sizes]
    begins[1] = begins[1] + len(flat[0])
    oh, ol, ids, light = (pa.concat_arrays([x.field(c) for x in flat]) for c in ("oh", "ol", "seq_id", "l"))
    oh, ol = (x.to_numpy(zero_copy_only=False) for x in (oh, ol))
    coded = light.dictionary_encode()
    code, texts = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    table = None
    if len(texts) ** 2 <= PAIRS:
        table = _light_distances(texts, *(x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts)), indexing="ij")), length_diff).reshape(len(texts), -1)
    heavy, same = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("heavy", "same"))
    counts = sizes[0] * sizes[1]
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), PAIRS, "right")) + at)
        row = np.repeat(np.arange(at, end), counts[at:end])
        within = np.arange(len(row)) - np.repeat(np.cumsum(counts[at:end]) - counts[at:end], counts[at:end])
        i, j = within // sizes[1][row], within % sizes[1][row]
        at = end
        keep = np.flatnonzero(~same[row] | (i < j))
        row = row[keep]
        i, j = begins[0][row] + i[keep], begins[1][row] + j[keep]
        far = table[code[i], code[j]] if table is not None else _light_distances(texts, code[i], code[j], length_diff)
        found = HEAVY_WEIGHT * heavy[row] + LIGHT_WEIGHT * far
        keep = np.flatnonzero(found <= max_dist)
        row, i, j, found = row[keep], i[keep], j[keep], found[keep]
        in_order = (oh[i] < oh[j]) | (oh[i] == oh[j]) & (ol[i] < ol[j])
        first, second, rows = pa.array(np.where(in_order, i, j)), pa.array(np.where(in_order, j, i)), pa.array(row)
        h_a, h_b = (batch.column(c).take(rows) for c in ("h_a", "h_b"))
        mask = pa.array(in_order)
        text = lambda h, k: pc.binary_join_element_wise(h, light.take(k), "|")
        yield pa.RecordBatch.from_arrays(
            [ids.take(first), ids.take(second), text(pc.if_else(mask, h_a, h_b), first), text(pc.if_else(mask, h_b, h_a), second), pa.array(found), pa.array(["paired"] * len(found), pa.string())],
            names=["seq_id_1", "seq_id_2", "cdr3_1", "cdr3_2", "distance", "chain"],
        )
