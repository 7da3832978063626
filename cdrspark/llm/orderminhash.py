"""Near-duplicate documents by Order MinHash and banded alignment.

A document is its sequence of 5-word shingles, each labelled with how often it occurred before. A sketch
takes the `KEPT` smallest labelled shingles under a random order, puts them back into text order and
hashes that sequence, so it tells not only which shingles two texts share but whether in one order.
Documents that agree in one of `SKETCHES` sketches are candidates. Verification aligns the two labelled
sequences inside the band that the threshold allows; m aligned of a and b shingles are a similarity of
m / (a + b - m), an ordered Jaccard similarity, and 0.8 makes a link. Classes are the components of links.

With KEPT = 5 and SKETCHES = 28, a pair at exactly 0.8 shares no sketch with probability 2e-5, while one at 0.3
shares one with 0.07. Texts of at most 50 shingles have 12 sketches of 2 kept ones (2e-5 too).

Texts with equal words are one node. Of a bucket every member is verified against
the most central one, the others outside its component against the most central of them; what is then still in several
components is compared member by member, but never inside the bucket's main component. In large buckets pairs that need a
rare shingle in common are found by it; of the others only members take part whose frequent shingles alone are enough for some
partner, in parts of bounded size. Pairs are aligned only if a sketch of 128 bins says that they can be a link (one at 0.8
fails with probability 1e-6). So links between texts that share a sketch are inside a class, whatever the size of a group. Pages
made of a few frequent blocks have many pairs just below the threshold, and the comparisons (not the alignments) of such
a group grow with the square of a bucket.

Defined results: words are runs of letters, digits and underscores in lower case; a text of fewer than 5 words (not
none) is one shingle; texts without a word (null, empty, only marks) are one class; class_id is the smallest doc_id of
the class (null if it has none); repeated rows are rows of their own in one class; other columns pass through, but
for those named like the results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdrspark.llm.common import from_texts, give_back, mixed, remembered, scratch, spread_join, written
from cdrspark.operators.graph import components

SHINGLE, KEPT, SKETCHES = 5, 5, 28
#: Short texts: fewer kept shingles, so that those of near copies can all be common ones.
SHORT_KEPT, SHORT_SKETCHES, SHORT_TO, LONG_FROM = 2, 12, 50, 40
#: Members of a bucket, and nodes of a shingle, that are paired with each other without more conditions.
LARGE = 64
#: Members of a large bucket that one task compares with all its others, about.
PART = 4096
#: Bins of the sketch that decides on alignment (a byte each), and by how many standard deviations it may fall short.
BINS, DEVIATIONS = 128, 4.9
WORD = re.compile(r"\w+")
REMEMBERED = 200_000

_ODD = mixed(np.arange(SHINGLE + SKETCHES, dtype=np.uint64), 11) | np.uint64(1)


class _Words(dict):
    """32-bit ids of words; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word)
        return h


def words_of(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(remembered("words", _Words).__getitem__, words), np.uint32, len(words))


def labelled(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the labelled shingles, in text order, all different."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    w = mixed(words, 3)
    with np.errstate(over="ignore"):
        s = np.full(len(w) - size + 1, size, np.uint64)
        for j in range(size):
            s = s * _ODD[j] + w[j : len(w) - size + 1 + j]
    s = mixed(s, 4)
    order = np.argsort(s, kind="stable")
    same = np.flatnonzero(s[order][1:] == s[order][:-1]) + 1
    if len(same):
        first = np.arange(len(s))
        first[same] = 0
        nth = np.arange(len(s)) - np.maximum.accumulate(first)
        s[order] = mixed(s[order] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5)
    return s


def _kept_in_order(h: np.ndarray, at: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A hash of each row's chosen shingles in text order."""
    chosen, total = h[np.sort(at, axis=1)], salts.astype(np.uint64)
    for j in range(at.shape[1]):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + chosen[:, j], 6)
    return total


def sketch(h: np.ndarray) -> np.ndarray:
    """The sketches (signed 64 bits, none for no shingles).

    Texts of LONG_FROM shingles or more have SKETCHES long ones, of SHORT_TO or fewer SHORT_SKETCHES short ones; two
    texts that differ by at most a fifth in size have a kind in common."""
    if not len(h):
        return np.zeros(0, np.int64)
    out = []
    step = max(1, 400_000 // len(h))
    for lo in range(0, SKETCHES, step):
        number = np.arange(lo, min(SKETCHES, lo + step))
        with np.errstate(over="ignore"):
            values = h * _ODD[SHINGLE + number][:, None]
            values ^= values >> np.uint64(32)
            values *= np.uint64(0xD6E8FEB86659FD93)
            kept = min(KEPT if len(h) >= LONG_FROM else SHORT_KEPT, len(h))
            at = np.argpartition(values, kept - 1, axis=1)[:, :kept] if kept < len(h) else np.broadcast_to(np.arange(kept), (len(number), kept))
            ranked = np.take_along_axis(at, np.argsort(np.take_along_axis(values, at, 1), axis=1), 1)
            if len(h) >= LONG_FROM:
                out.append(_kept_in_order(h, ranked, number))
            if len(h) <= SHORT_TO and lo < SHORT_SKETCHES:
                few = number[number < SHORT_SKETCHES]
                out.append(_kept_in_order(h, ranked[: len(few), :SHORT_KEPT], few + SKETCHES))
    return np.concatenate(out).view(np.int64)


def binned(h: np.ndarray) -> np.ndarray:
    """A byte for the smallest shingle in each of BINS equal parts of a hash's range, 0 for an empty one; as longs."""
    out = np.zeros(BINS, np.uint8)
    if len(h):
        value = np.sort(mixed(h, 8))
        part = (value >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[first]] = 1 + (value[first] >> np.uint64(8)) % np.uint64(255)
    return out.view(np.int64)


def longest_rise(values: np.ndarray) -> int:
    """Length of the longest increasing subsequence of different numbers."""
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return len(values)
    from bisect import bisect_left

    ends: list[int] = []
    for v in values.tolist():
        i = bisect_left(ends, v)
        ends[i : i + 1] = [v]
    return len(ends)


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Ordered Jaccard similarity of two labelled sequences, by alignment inside the band of `least`; 0 if it is below.

    Labelled shingles are all different, so an alignment is an increasing sequence of places of common ones. With
    similarity `least` or more at most (1 - least) / (1 + least) of all shingles are without a partner, and no
    aligned pair lies further off the diagonal."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    total = len(a) + len(b)
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(common) < least * (total - len(common)):
        return 0.0
    band = int(total * (1 - least) / (1 + least)) + 1
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    m = longest_rise(at_b[np.argsort(at_a)])
    found = m / (total - m)
    return found if found >= least else 0.0


def prepared(docs: DataFrame, keep: bool = False) -> DataFrame:
    """docs (without text unless keep), with uid (a number for each row), fp (words' digest), n (shingles), sketches, bins and words (32-bit
    ids); written to the shared folder."""

    def start():
        def run(texts: list) -> dict[str, list]:
            out: dict[str, list] = {"fp": [], "n": [], "sketches": [], "bins": [], "words": []}
            for text in texts:
                words = words_of(text)
                h = labelled(words)
                raw = words.tobytes()
                out["fp"].append(hashlib.blake2b(raw, digest_size=16).digest())
                out["n"].append(len(h))
                out["sketches"].append(sketch(h))
                out["bins"].append(binned(h))
                out["words"].append(raw)
            return out

        return run

    made = {"fp": "binary", "n": "int", "sketches": "array<long>", "bins": "array<long>", "words": "binary"}
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {*made, "uid"}])
    return written(from_texts(own, made, start, keep=keep, memory="words").withColumn("uid", F.monotonically_increasing_id()), "omh")


def _zeros(z: Column) -> Column:
    """Bytes of a long that are zero."""
    for k in (4, 2, 1):
        z = z.bitwiseOR(F.shiftrightunsigned(z, k))
    return F.lit(8) - F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))


def _alike(x: str, y: str, least: float) -> Column:
    """Whether the bins of two texts allow a similarity of `least`: of the bins that are not empty in both as many agree as such
    a pair has, less DEVIATIONS standard deviations and one. Lambdas keep the generated code small."""
    counted = F.zip_with(x, y, lambda a, b: F.struct(_zeros(a.bitwiseXOR(b)).alias("equal"), _zeros(a.bitwiseOR(b)).alias("empty")))
    enough = lambda s: s["equal"] - s["empty"] >= F.lit(least) * (F.lit(BINS) - s["empty"]) - F.lit(DEVIATIONS * (least * (1 - least)) ** 0.5) * F.sqrt(F.lit(BINS) - s["empty"]) - 1
    return F.aggregate(counted, F.struct(F.lit(0).alias("equal"), F.lit(0).alias("empty")), lambda s, c: F.struct((s["equal"] + c["equal"]).alias("equal"), (s["empty"] + c["empty"]).alias("empty")), enough)


def _verified(pairs: DataFrame, nodes: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Of pairs (u, v) the links, written to the shared folder."""
    a = nodes.select(F.col("uid").alias("u"), F.col("n").alias("n_u"), F.col("bins").alias("bins_u"))
    b = nodes.select(F.col("uid").alias("v"), F.col("n").alias("n_v"), F.col("bins").alias("bins_v"))
    near = pairs.join(a, "u").join(b, "v")
    near = near.filter(_sizes_fit("n_u", "n_v", least) & _alike("bins_u", "bins_v", least))
    near = written(near.select("u", "v"), "omh-pairs")
    # Only the texts that occur in pairs move, and once for both sides.
    used = near.select(F.col("u").alias("uid")).unionByName(near.select(F.col("v").alias("uid"))).distinct()
    used = written(words.join(used.hint("merge"), "uid", "left_semi"), "omh-words")
    both = near.join(used.select(F.col("uid").alias("u"), F.col("words").alias("words_u")), "u").join(used.select(F.col("uid").alias("v"), F.col("words").alias("words_v")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            keep, known = [], (None, None)
            for i in range(batch.num_rows):
                raw = batch.column("words_v")[i].as_buffer()
                v = batch.column("v")[i].as_py()
                if known[0] != v:
                    known = (v, labelled(np.frombuffer(raw, np.uint32)))
                u = labelled(np.frombuffer(batch.column("words_u")[i].as_buffer(), np.uint32))
                keep.append(similarity(u, known[1], least) > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])

    return written(both.select("u", "v", "words_u", "words_v").mapInArrow(run, "u long, v long"), "omh-links")


def _shingles(uids: DataFrame, words: DataFrame) -> DataFrame:
    """uid and h, a row for each labelled shingle of these nodes; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for i in range(batch.num_rows):
                h = labelled(np.frombuffer(batch.column("words")[i].as_buffer(), np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), batch.column("uid")[i].as_py())), pa.array(h.view(np.int64))], names=["uid", "h"])

    return written(words.join(uids.hint("merge"), "uid", "left_semi").select("uid", "words").mapInArrow(run, "uid long, h long"), "omh-shingles")


def _in_large_buckets(held: DataFrame, info: DataFrame, words: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """What buckets of more than LARGE members need: the nodes' number of frequent shingles (uid, frequent), and
    pairs (u, v) of different components that share enough rare ones.

    Two texts share at most the smaller number of frequent shingles (those of more than LARGE nodes here). If a link
    needs more than that, they share a rare shingle, and of those every node meets at most LARGE others."""
    each = _shingles(held.select("uid").distinct(), words)
    counts = written(each.groupBy("h").agg(F.count("*").alias("df"), F.min("uid").alias("uid")).filter(F.col("df") <= LARGE), "omh-rare")
    single = counts.filter("df = 1").groupBy("uid").agg(F.count("*").alias("single"))
    rare = written(each.join(counts.filter("df > 1").select("h"), "h"), "omh-rare")
    several = rare.groupBy("uid").agg(F.count("*").alias("several"))
    known = info.join(held.select("uid", "comp").distinct(), "uid").join(single, "uid", "left").join(several, "uid", "left")
    known = known.withColumn("frequent", F.col("n") - F.coalesce("single", F.lit(0)) - F.coalesce("several", F.lit(0)))
    known = written(known.select("uid", "comp", "n", "frequent"), "omh-known")
    rare = rare.join(known, "uid")
    x, y = rare.alias("x"), rare.alias("y")
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.uid") > F.col("y.uid")) & _sizes_fit("x.n", "y.n", least))
    met = met.groupBy(F.col("x.uid").alias("u"), F.col("y.uid").alias("v")).agg(F.count("*").alias("shared"), F.first(F.col("x.n") + F.col("y.n")).alias("n"), F.first(F.least("x.frequent", "y.frequent")).alias("frequent"))
    return known.select("uid", "frequent"), met.filter(_enough(F.col("shared") + F.col("frequent"), F.col("n"), least)).select("u", "v")


def _enough(common: Column, total: Column, least: float) -> Column:
    """Whether two texts of `total` shingles can be a link with so many common ones: no less than `least` / (1 + `least`) of
    them. Both are whole numbers, and the product may be rounded up at exactly `least`, so it is lowered a little."""
    return common >= F.lit(least / (1 + least)) * total - F.lit(1e-6)


def _sizes_fit(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b)


def classes(table: DataFrame, least: float = 0.8) -> DataFrame:
    """Of a prepared() table uid and comp (the smallest uid that stands for different words in its class), as a table;
    the working tables are deleted."""
    with scratch(table.sparkSession) as keep:
        return keep(written(_classes(table, least), "omh-classes"))


def _classes(table: DataFrame, least: float) -> DataFrame:
    words = table.select("uid", "words")
    best = F.min(F.struct("uid", "n", "sketches", "bins")).alias("r")
    nodes = table.groupBy("fp").agg(best, F.count("*").alias("copies"))
    nodes = written(nodes.select("fp", "copies", "r.uid", "r.n", "r.sketches", "r.bins"), "omh-nodes")

    each = nodes.select("uid", F.explode("sketches").alias("b"))
    shared = each.groupBy("b").agg(F.count("*").alias("k")).filter(F.col("k") > 1)
    members = written(each.join(shared, "b"), "omh-buckets")

    # The only join that moves all words: to the nodes that share a sketch. Later ones move these nodes' words.
    words = written(words.join(members.select("uid").distinct().hint("merge"), "uid", "left_semi"), "omh-words")

    # An original shares more sketches with its copies than they do with each other, so it heads its buckets.
    central = members.groupBy("uid").agg(F.sum("k").alias("central"))
    members = written(members.drop("k").join(central, "uid"), "omh-central")
    most_central = F.max(F.struct("central", (-F.col("uid")).alias("minus"))).alias("t")
    heads = written(members.groupBy("b").agg(most_central).select("b", (-F.col("t.minus")).alias("head")), "omh-heads")
    first = members.join(heads, "b").filter(F.col("uid") != F.col("head"))
    first = written(first.select(F.greatest("uid", "head").alias("u"), F.least("uid", "head").alias("v")).distinct(), "omh-first")
    links = _verified(first, nodes, words, least)
    comp = components(links)

    # Then the most central one outside the head's component against all others there.
    def labelled_members() -> DataFrame:
        return members.join(comp.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))

    def more_linked(more: DataFrame) -> DataFrame:
        return comp if more.isEmpty() else components(comp.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(more))

    held = labelled_members()
    main = held.join(heads, "b").filter(F.col("uid") == F.col("head")).select("b", F.col("comp").alias("main")).distinct()
    outside = written(held.join(main, "b").filter(F.col("comp") != F.col("main")).select("b", "uid", "central"), "omh-outside")
    if not outside.isEmpty():
        seconds = outside.groupBy("b").agg(most_central).select("b", (-F.col("t.minus")).alias("head2"))
        second = outside.join(seconds, "b").filter(F.col("uid") != F.col("head2"))
        second = written(second.select(F.greatest("uid", "head2").alias("u"), F.least("uid", "head2").alias("v")).distinct().join(first, ["u", "v"], "left_anti"), "omh-second")
        comp = more_linked(_verified(second, nodes, words, least))
        # What is left: in buckets with several components, every member outside the head's against all others.
        held = labelled_members()
        mixed_up = held.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).filter("lo <> hi").select("b", "k")
        held = written(held.join(mixed_up, "b").join(heads, "b").select("b", "uid", "comp", "head", "k"), "omh-mixed")
        if not held.isEmpty():
            third = written(_left_over(held, nodes, words, least).join(first.unionByName(second), ["u", "v"], "left_anti"), "omh-third")
            comp = more_linked(_verified(third, nodes, words, least))

    # A row whose text occurs once is its own node; the others find theirs by the digest, of which one may have very many rows.
    placed = nodes.select("fp", "copies", F.col("uid").alias("node")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = written(placed, "omh-placed")
    alone = placed.filter("copies = 1").select(F.col("node").alias("uid"), "comp")
    repeated = placed.filter("copies > 1").select("fp", "comp", "copies")
    total = placed.agg(F.sum("copies")).first()[0] or 0
    return alone.unionByName(spread_join(table.select("uid", "fp"), repeated, "fp", "copies", total).select("uid", "comp"))


def _left_over(held: DataFrame, nodes: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of different components in one bucket (held: b, uid, comp, head, k) of which one is outside the head's component,
    and that can be links."""
    main = held.filter(F.col("uid") == F.col("head")).select("b", F.col("comp").alias("main"))
    large = held.filter(F.col("k") > LARGE)
    known = held.join(main, "b").join(nodes.select("uid", "n", "bins"), "uid")
    by_rare = None
    if large.isEmpty():
        known = known.withColumn("frequent", F.lit(None).cast("long"))
    else:
        frequent, by_rare = _in_large_buckets(large, nodes.select("uid", "n"), words, least)
        known = known.join(frequent, "uid", "left")
    # In a large bucket a member without enough frequent shingles for any partner that its size allows has none that is left.
    known = known.filter((F.col("k") <= LARGE) | (F.col("frequent") >= F.lit(least) * F.col("n") - F.lit(1e-6)))
    parts = F.ceil(F.col("k") / PART).cast("int")
    known = written(known.select("b", "uid", "comp", (F.col("comp") == F.col("main")).alias("is_main"), "k", "n", "bins", "frequent", parts.alias("parts")), "omh-known")
    x = known.filter(~F.col("is_main")).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).alias("x")
    y = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    once = F.col("y.is_main") | (F.col("x.uid") > F.col("y.uid"))
    enough = (F.col("x.k") <= LARGE) | (_enough(F.least("x.frequent", "y.frequent"), F.col("x.n") + F.col("y.n"), least))
    same = (F.col("x.b") == F.col("y.b")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.comp") != F.col("y.comp"))
    pairs = x.join(y, same & once & enough & _sizes_fit("x.n", "y.n", least) & _alike("x.bins", "y.bins", least))
    pairs = pairs.select(F.greatest("x.uid", "y.uid").alias("u"), F.least("x.uid", "y.uid").alias("v"))
    return (pairs.unionByName(by_rare) if by_rare is not None else pairs).distinct()


def near_duplicates(docs: DataFrame, least: float = 0.8, keep: bool = False) -> DataFrame:
    """docs (without text unless keep), with class_id, class_size and stays (the first row of each class by doc_id, null last)."""
    names = [c for c in docs.columns if c not in ("class_id", "class_size", "stays") and (keep or c != "text")]
    rest = [c for c in names if c not in ("doc_id", "text")]
    # Other columns travel in a struct, so none of their names can meet a working column's.
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("omh"), *[F.col(f"`{c}`") for c in rest]).alias("omh_rest"))
    table = prepared(packed, keep)
    rows = written(table.select("uid", "doc_id").join(classes(table, least), "uid"), "omh-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("uid"))
    of = rows.groupBy("comp").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    of = written(of.select("comp", F.col("first.doc_id").alias("class_id"), F.col("first.uid").alias("first_uid"), "class_size", F.col("class_size").alias("rows")), "omh-of")
    told = spread_join(rows, of, "comp", "rows", rows.count()).select("uid", "class_id", "class_size", (F.col("uid") == F.col("first_uid")).alias("stays"))
    # The only join that moves the other columns of docs.
    out = table.select("uid", "doc_id", *["text"] * keep, "omh_rest").join(told, "uid")
    return out.select(*[F.col(f"omh_rest.`{c}`") if c in rest else F.col(c) for c in names], "class_id", "class_size", "stays")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "stays")
