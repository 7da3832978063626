"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: a share of all words is dealt to the sources by weight; no source gets more than
   ``max_epochs`` times its size, and what it can't use is dealt to the others by weight.
2. Draws: a source's documents lie in hashed blocks of about ``block_words``, so the order of blocks is a random one. A source
   gives all blocks in whole epochs and, for the rest of its target, blocks in their order up to the one in which
   the target lies. Of that one the documents are taken in hash order; which of the WINDOW around the target is
   decided by the subset whose sum is nearest to it.
3. Dealing: the drawn blocks of all epochs are counted, and these exact counts are the quotas of the tree. At each node
   the left half of the shards gets a multivariate hypergeometric sample of what the node has. Each source's drawn blocks are
   permuted by hash, and a shard gets the disjoint run that the tree gives it. There are as many shards as the drawn words need at
   ``shard_words`` each; a shard's rows are ordered by hash.

Everything random is a hash of ids and the seed, so reruns and lost executors give the same mix.

Defined results: a null or empty text has size 0 and is taken 0 words; the null source is a source
of its own, last in order; repeated rows (same id, source and text) share one hash and are drawn together; a
single source's target is at most ``max_epochs`` times its size; an empty table gives an empty mix; other columns are ignored
by ``plan`` and kept by ``mix``; more than ``max_sources`` sources are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cdrspark.llm.common import written

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words (about) in a block and in a shard.
BLOCK_WORDS, SHARD_WORDS = 32_768, 4_194_304
#: Blocks of a source are summed in so many cells at once; shards that one step of the tree splits a node into; documents
#: around a target whose subsets are compared.
CELLS, LEAVES, WINDOW = 1024, 64, 64


@dataclass(frozen=True)
class Source:
    """What the driver knows of a source: one record per source, none per document."""

    name: str | None
    docs: int
    size: int
    weight: float
    target: float
    blocks: int

    @property
    def epochs(self) -> int:
        return int(self.target // self.size) if self.size else 0

    @property
    def rest(self) -> float:
        return self.target - self.epochs * self.size


def targets(sizes: list[int], weights: list[float], total: float, max_epochs: float) -> list[float]:
    """`total` dealt by weight, none above max_epochs times its size, the excess dealt again by weight."""
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(total)
    while free:
        weight = math.fsum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / weight >= max_epochs * sizes[i]}
        for i in full:
            out[i] = float(max_epochs * sizes[i])
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        left -= math.fsum(out[i] for i in full)
        free -= full
    return out


def split_node(have: np.ndarray, lo: int, hi: int, leaves: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of a node of shards lo to hi that has these block draws of each source: the nodes under it (lo, hi, block draws), `leaves` at
    most. Halves get parts by their shards (to one block), and every node has its own generator, so how many are split at once changes nothing."""
    if hi - lo == 1 or leaves == 1:
        yield lo, hi, have
        return
    mid, total = (lo + hi) // 2, int(have.sum())
    to_left = total * (mid - lo) // (hi - lo)
    # One source at a time: hypergeometric given what the sources before it got.
    rng = np.random.default_rng([seed, lo, hi])
    left, rest = np.zeros_like(have), total
    for i in np.flatnonzero(have).tolist():
        n = int(have[i])
        rest -= n
        left[i] = rng.hypergeometric(n, rest, to_left) if to_left else 0
        to_left -= int(left[i])
    yield from split_node(left, lo, mid, leaves // 2, seed)
    yield from split_node(have - left, mid, hi, leaves // 2, seed)


def dealt_blocks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """s, shard, blocks (more than 0): the tree over quotas (s, blocks), some levels a step. A task holds one node's sources
    and what they have in LEAVES nodes under it."""

    def split(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("s")
        s, out = part["s"].to_numpy(), []
        for lo, hi, have in split_node(part["blocks"].to_numpy(np.int64), int(part["lo"].iloc[0]), int(part["hi"].iloc[0]), LEAVES, seed):
            some = have > 0
            out.append(pd.DataFrame({"lo": lo, "hi": hi, "s": s[some], "blocks": have[some]}))
        return pd.concat(out)

    nodes, widest = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "s", "blocks"), shards
    while widest > 1:
        nodes = written(nodes.groupBy("lo", "hi").applyInPandas(split, "lo int, hi int, s int, blocks long"), "mix-nodes")
        widest = -(-widest // LEAVES)
    return nodes.select("s", F.col("lo").alias("shard"), "blocks")


def filled_up(size: np.ndarray, left: float) -> np.ndarray:
    """Which documents, in this order, come nearest to `left` words: all before the WINDOW around it, and of these the best subset."""
    at = int(np.searchsorted(np.cumsum(size), left, side="right"))
    lo = max(0, min(at - WINDOW // 2, len(size) - WINDOW))
    taken = np.arange(len(size)) < lo
    taken[lo : lo + WINDOW] = nearest_subset(size[lo : lo + WINDOW].tolist(), left - float(size[:lo].sum()))
    return taken


def nearest_subset(size: list[int], left: float) -> np.ndarray:
    """The subset whose sum is nearest to `left` (of equal ones the smaller sum, earlier documents first), by the bits of all reachable sums."""
    reach = [1]
    for n in size:
        reach.append(reach[-1] | reach[-1] << n)
    sums, low = reach[-1], max(0, int(left))
    below = (sums & ((1 << (low + 1)) - 1)).bit_length() - 1
    above = sums >> (low + 1)
    total = below
    if above and (low + 1 + (above & -above).bit_length() - 1) - left < left - below:
        total = low + (above & -above).bit_length()
    taken = np.zeros(len(size), bool)
    for i in range(len(size) - 1, -1, -1):
        if not reach[i] >> total & 1:
            taken[i], total = True, total - size[i]
    return taken


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and two hashes, as a table; the only pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return written(
        docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash")),
        "mix-sizes",
    )


def known_sources(sized: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, most: int, block_words: int) -> list[Source]:
    """One record per source, by code point, null last. Sources are few beside documents; more than `most` end the job."""
    rows = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("size")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources; raise max_sources if the driver can hold them")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    use = [float(weights[i % len(weights)]) for i in range(len(rows))]
    want = targets([r["size"] for r in rows], use, share * sum(r["size"] for r in rows), max_epochs)
    return [Source(r.source, r.docs, r["size"], w, t, max(1, -(-r["size"] // block_words))) for r, w, t in zip(rows, use, want, strict=True)]


def _cut(units: DataFrame, sources: list[Source], spark: SparkSession) -> DataFrame:
    """s, cut, left: of each source with a rest the block in which it ends, and the words that it takes from that block. Cells
    of blocks are summed, then the cells of the one in which the rest ends, until a cell is a block: a source has
    at most CELLS sums at once, however many blocks."""
    some = [(i, s.rest, s.blocks) for i, s in enumerate(sources) if s.rest > 0]
    open_ = spark.createDataFrame([(i, 0, float(rest)) for i, rest, _ in some], "s int, cut long, left double")
    width = {i: blocks for i, _, blocks in some}
    while any(w > 1 for w in width.values()):
        finer = {i: -(-w // CELLS) for i, w in width.items()}
        steps = spark.createDataFrame([(i, width[i], finer[i]) for i in width], "s int, width long, finer long")
        # One row a source in both.
        inside = units.join(F.broadcast(open_.join(steps, "s")), "s").filter(F.col("block").between(F.col("cut"), F.col("cut") + F.col("width") - 1))
        cells = inside.groupBy("s", "cut", "left", "finer", F.floor((F.col("block") - F.col("cut")) / F.col("finer")).alias("cell")).agg(F.sum("words").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("cell"))
        cells = cells.withColumn("before", upto - F.col("words")).filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
        open_ = written(cells.select("s", (F.col("cut") + F.col("cell") * F.col("finer")).alias("cut"), (F.col("left") - F.col("before")).alias("left")), "mix-cut")
        width = finer
    return open_


def plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    seed: int = 17,
    max_sources: int = 200_000,
) -> DataFrame:
    """For each row of docs (doc_id, source, text): doc_id, source, text_hash, size, source_size,
    target (its source's) and draws, an array with an entry (epoch, shard, position) for each time it is taken."""
    return _planned(docs, weights, share, max_epochs, shard_words, block_words, seed, max_sources)[0]


def _planned(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, seed: int = 17, max_sources: int = 200_000) -> tuple[DataFrame, int]:
    """plan()'s rows and the number of shards."""
    spark = docs.sparkSession
    sized = sizes(docs)
    sources = known_sources(sized, weights, share, max_epochs, max_sources, block_words)
    shards = max(1, math.ceil(math.fsum(s.target for s in sources) / shard_words))
    known = spark.createDataFrame([(i, s.name, s.size, s.target, s.epochs, s.blocks) for i, s in enumerate(sources)], "s int, name string, source_size long, target double, epochs int, blocks long")
    # One row per source, at most max_sources of them: small enough for every executor.
    rows = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    of_row = ("source", "doc_id", "text_hash")
    rows = rows.withColumns({"h": _hash(F.lit(seed), *of_row), "block": F.pmod(_hash(F.lit(seed + 3), *of_row), "blocks")})

    units = written(rows.filter("size > 0").groupBy("s", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    cut = _cut(units, sources, spark)
    in_cut = rows.filter("size > 0").join(F.broadcast(cut), "s").filter(F.col("block") == F.col("cut"))
    in_cut = in_cut.groupBy("s", "h", "text_hash", "left").agg(F.sum("size").alias("size"))

    def fill(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["h", "text_hash"], kind="stable")
        return batch[filled_up(batch["size"].to_numpy(np.int64), float(batch["left"].iloc[0]))][["s", "h", "text_hash"]]

    filled = written(in_cut.groupBy("s").applyInPandas(fill, "s int, h long, text_hash long"), "mix-filled")

    # The drawn blocks: whole epochs, the rest's whole blocks, and the cut one if any of its documents is taken.
    some = filled.select("s").distinct().withColumn("some", F.lit(True))
    of_source = known.select("s", "epochs").join(cut.select("s", "cut").join(some, "s", "left"), "s", "left")
    part = (F.col("block") < F.col("cut")) | ((F.col("block") == F.col("cut")) & F.col("some").isNotNull())
    times = F.col("epochs") + F.when(F.coalesce(part, F.lit(False)), 1).otherwise(0)
    drawn = units.join(F.broadcast(of_source), "s").withColumn("times", times).filter("times > 0")
    drawn = drawn.select("s", "block", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
    drawn = drawn.withColumn("turn", _hash(F.lit(seed + 5), "s", "block", "epoch"))
    # Numbered within each source in the order of the hash: inside parts of a range partitioning, after those of earlier parts.
    key = ("turn", "block", "epoch")
    parts = written(drawn.repartitionByRange("s", *key).withColumn("part", F.spark_partition_id()), "mix-drawn")
    counts = written(parts.groupBy("s", "part").agg(F.count("*").alias("n")), "mix-parts")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("part")) - F.col("n")).drop("n")
    numbered = parts.join(before, ["s", "part"]).withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("s", "part").orderBy(*key)) - 1)

    quotas = counts.groupBy("s").agg(F.sum("n").alias("blocks"))
    runs = dealt_blocks(quotas, shards, seed)
    upto = F.sum("blocks").over(Window.partitionBy("s").orderBy("shard"))
    places = runs.withColumn("upto", upto).select("s", "shard", F.explode(F.sequence(F.col("upto") - F.col("blocks"), F.col("upto") - 1)).alias("i"))
    dealt = numbered.join(places, ["s", "i"]).groupBy("s", "block").agg(F.collect_list(F.struct("epoch", "shard")).alias("dealt"))

    chosen = rows.join(dealt, ["s", "block"], "left").join(F.broadcast(cut.select("s", "cut")), "s", "left")
    chosen = chosen.join(filled.withColumn("extra", F.lit(True)), ["s", "h", "text_hash"], "left")
    whole = lambda d: (d["epoch"] < F.col("epochs")) | (F.col("block") < F.col("cut")) | F.coalesce(F.col("extra"), F.lit(False))
    draws = F.transform(F.filter(F.array_sort("dealt"), whole), lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), _hash(d["epoch"] + F.lit(seed + 9), F.col("h")).alias("position")))
    nothing = F.array().cast("array<struct<epoch:int,shard:int,position:bigint>>")
    draws = F.when((F.col("size") > 0) & F.col("dealt").isNotNull(), draws).otherwise(nothing)
    return chosen.select("doc_id", "source", "text_hash", "size", "source_size", "target", draws.alias("draws")), shards


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, each as often as the mix takes it, dealt to shards and in hash order inside a shard,
    with the columns mix_epoch and mix_shard added (replacing any of these names). A shard is one partition."""
    planned, shards = _planned(docs.select("doc_id", "source", "text"), **options)
    drawn = planned.filter(F.size("draws") > 0).groupBy("doc_id", "source", "text_hash").agg(F.first("draws").alias("mix_draws"))
    own = [c for c in docs.columns if c not in ("mix_epoch", "mix_shard")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in own]).withColumn("mix_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = keyed.alias("d").join(
        drawn.alias("p"),
        F.col("d.mix_hash").eqNullSafe(F.col("p.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")),
    )
    out = joined.select(*[F.col(f"d.`{c}`") for c in own], F.explode("p.mix_draws").alias("mix_draw"))
    out = out.repartitionById(shards, F.col("mix_draw.shard")).sortWithinPartitions("mix_draw.position")
    return out.select(*[F.col(f"`{c}`") for c in own], F.col("mix_draw.epoch").alias("mix_epoch"), F.col("mix_draw.shard").alias("mix_shard"))


def op1_mix_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"))
