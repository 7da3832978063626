"""Operators over whole tables: mixing, archives, neighbours, near copies, lines, and the pipeline."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cdrspark.llm import ann, common, langid, linededup, mix, orderminhash, warc
from cdrspark.sources.readers import exists
from tests.llm import odd

# -- mixing ---------------------------------------------------------------------------------


def test_targets():
    assert mix.targets([100, 100, 100], [3, 1, 2], 450, 2) == [200.0, 250 / 3, 500 / 3]
    got = mix.targets([10, 1000, 1000], [3, 1, 2], 3015, 2)
    assert got == [20.0, 2995 / 3, 2 * 2995 / 3] or got[0] == 20.0
    assert mix.targets([], [], 0, 2) == []
    assert mix.targets([0, 5], [1, 1], 7.5, 2) == [0.0, 7.5]


def tree(quotas, shards, seed, leaves=10**9):
    """Block draws of each source (row) in each shard (column), by steps of so many leaves."""
    nodes, out = [(0, shards, np.array(quotas, np.int64))], np.zeros((len(quotas), shards), np.int64)
    while any(hi - lo > 1 for lo, hi, _ in nodes):
        nodes = [child for lo, hi, have in nodes for child in mix.split_node(have, lo, hi, leaves, seed)]
    for lo, _, have in nodes:
        out[:, lo] = have
    return out


def test_splitting_tree_keeps_quotas():
    quotas = [1000, 3, 0, 77]
    out = tree(quotas, 7, 1)
    assert (out.sum(axis=1) == quotas).all() and (out >= 0).all()
    assert set(np.diff(np.sort(out.sum(axis=0))).tolist()) <= {0, 1}
    assert np.array_equal(out, tree(quotas, 7, 1)) and np.array_equal(out, tree(quotas, 7, 1, 2)) and np.array_equal(out, tree(quotas, 7, 1, 4))
    assert not np.array_equal(out, tree(quotas, 7, 2))


def test_tree_over_tables(spark, monkeypatch):
    quotas = [40, 0, 500, 7]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(quotas) if n], "s int, blocks long")
    for leaves in (2, 8, 64):
        monkeypatch.setattr(mix, "LEAVES", leaves)
        got = np.zeros((4, 19), np.int64)
        for r in mix.dealt_blocks(rows, 19, 5).collect():
            got[r["s"], r["shard"]] = r["blocks"]
        assert np.array_equal(got, tree(quotas, 19, 5))


def test_filled_up_comes_near():
    rng = random.Random(1)
    for _ in range(200):
        size = [rng.randrange(60) for _ in range(rng.randrange(1, 9))]
        left = rng.uniform(0, sum(size) + 5)
        best = min(abs(sum(c) - left) for k in range(len(size) + 1) for c in itertools.combinations(size, k))
        assert abs(np.array(size)[mix.nearest_subset(size, left)].sum() - left) == pytest.approx(best)
        assert abs(np.array(size)[mix.filled_up(np.array(size), left)].sum() - left) == pytest.approx(best)
    many = np.array([rng.randrange(1, 900) for _ in range(500)])
    for left in (0.0, 3.2, 70_000.5, float(many.sum()) - 0.5):
        assert abs(many[mix.filled_up(many, left)].sum() - left) <= 2


def plainly(spark, docs, shard_words, block_words, seed=17):
    """For each row how often it is taken and in which (epoch, shard), from the hashes of rows and blocks alone."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "source", text.alias("t"), F.xxhash64(text).alias("th"))
    keyed = keyed.select("*", *[F.xxhash64(F.lit(seed + k), "source", "doc_id", "th").alias(n) for n, k in (("h", 0), ("b", 3))]).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    names = sorted({r["source"] for r in keyed}, key=lambda s: (s is None, s or ""))
    total = {n: sum(words(r["t"]) for r in keyed if r["source"] == n) for n in names}
    want = mix.targets([total[n] for n in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5 * sum(total.values()), 2.0)
    shards = max(1, math.ceil(sum(want) / shard_words))
    taken, drawn = {}, []
    for s, n in enumerate(names):
        rows = {(r["h"], r["th"], r["doc_id"]): (r["b"] % max(1, -(-total[n] // block_words)), words(r["t"])) for r in keyed if r["source"] == n}
        copies = Counter((r["h"], r["th"], r["doc_id"]) for r in keyed if r["source"] == n)
        size = {k: copies[k] * w for k, (_, w) in rows.items() if w}
        epochs = int(want[s] // total[n]) if total[n] else 0
        left, rest = want[s] - epochs * total[n], set()
        by_block = defaultdict(list)
        for k in sorted(size):
            by_block[rows[k][0]].append(k)
        for block in sorted(by_block) if left > 0 else ():
            inside = sum(size[k] for k in by_block[block])
            if inside <= left:
                rest |= set(by_block[block])
                left -= inside
                continue
            chosen = mix.filled_up(np.array([size[k] for k in by_block[block]]), left)
            rest |= {k for k, c in zip(by_block[block], chosen, strict=True) if c}
            break
        for k in size:
            taken[n, k] = [(e, s, rows[k][0]) for e in range(epochs)] + [(epochs, s, rows[k][0])] * (k in rest)
        drawn += sorted({d for k in size for d in taken[n, k]})
    turn = {}
    if drawn:
        table = spark.createDataFrame([(s, b, e) for e, s, b in drawn], "s int, b long, e int")
        turn = {(r["e"], r["s"], r["b"]): r["turn"] for r in table.select("*", F.xxhash64(F.lit(seed + 5), "s", "b", "e").alias("turn")).collect()}
    place = {}
    counts = tree([sum(d[1] == s for d in drawn) for s in range(len(names))], shards, seed)
    for s in range(len(names)):
        own = sorted((d for d in drawn if d[1] == s), key=lambda d: (turn[d], d[2], d[0]))
        place |= dict(zip(own, np.repeat(np.arange(shards), counts[s]).tolist(), strict=True))
    return Counter((r["doc_id"], r["source"], r["th"], tuple((d[0], place[d]) for d in taken.get((r["source"], (r["h"], r["th"], r["doc_id"])), []))) for r in keyed), shards


@pytest.mark.parametrize(("shard_words", "block_words"), [(40_000, 32_768), (300, 60), (2000, 7)])
def test_plan_equals_plain_computation(spark, monkeypatch, shard_words, block_words):
    monkeypatch.setattr(mix, "CELLS", 4)
    docs = odd.table(spark)
    want, shards = plainly(spark, docs, shard_words, block_words)
    rows = mix.plan(docs, shard_words=shard_words, block_words=block_words).collect()
    assert Counter((r["doc_id"], r["source"], r["text_hash"], tuple((d["epoch"], d["shard"]) for d in r["draws"])) for r in rows) == want
    assert all(0 <= d["shard"] < shards for r in rows for d in r["draws"])


def test_plan(spark):
    docs = odd.table(spark).withColumn("draws", F.lit("clash"))
    rows = mix.plan(docs, shard_words=500, block_words=50).collect()
    assert len(rows) == len(odd.rows())
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
        assert len(r["draws"]) <= 2 and (r["size"] > 0 or not r["draws"])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mix.targets([size[s] for s in order], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2.0)
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["size"] * len(r["draws"])
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[order.index(r["source"])]) < 1e-6
    biggest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - t) <= biggest for s, t in zip(order, want, strict=True))
    again = mix.plan(docs.repartition(7), shard_words=500, block_words=50).collect()
    assert Counter(map(repr, rows)) == Counter(map(repr, again))
    assert mix.plan(odd.empty(spark)).count() == 0
    with pytest.raises(ValueError, match="sources"):
        mix.plan(docs, max_sources=2)


def test_shards_have_equal_words(spark):
    """Documents of very different sizes: shards of some hundred documents differ little, and their number follows the words."""
    size = F.when(F.col("id") % 50 == 0, 300).otherwise(F.col("id") % 40 + 1).cast("int")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), size).alias("text"))
    rows = mix.plan(docs, shard_words=100_000, block_words=800).collect()
    words = Counter()
    for r in rows:
        for d in r["draws"]:
            words[d["shard"]] += r["size"]
    assert len(words) == math.ceil(1.5 * sum(r["size"] for r in rows) / 100_000)
    mean = sum(words.values()) / len(words)
    assert all(abs(n - mean) < 0.1 * mean for n in words.values())


def test_mix_rows_follow_the_plan(spark):
    docs = odd.table(spark)
    out = mix.mix(docs.withColumn("mix_shard", F.lit("clash")), shard_words=20_000)
    times = Counter((r["doc_id"], r["text"], r["source"], r["mix_epoch"], r["mix_shard"]) for r in out.collect())
    plan = Counter()
    texts = {(r["doc_id"], r["source"], r["h"]): r["text"] for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    for r in mix.plan(docs, shard_words=20_000).collect():
        for d in r["draws"]:
            plan[r["doc_id"], texts[r["doc_id"], r["source"], r["text_hash"]], r["source"], d["epoch"], d["shard"]] += 1
    assert times == plan and len({s for *_, s in times}) > 1
    assert out.select(F.spark_partition_id().alias("p"), "mix_shard").distinct().filter("p <> mix_shard").count() == 0


# -- archives -------------------------------------------------------------------------------

PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (None, "http://e", "<p>x</p>"), (None, None, None), (9, "u r\nl", "é" * 100_000)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(1))
    archive = warc.write_archive(pages)
    rows = warc.read_index(spark, archive).collect()
    assert len(rows) == len(PAGES)
    by = defaultdict(list)
    for r in rows:
        by[r["payload_digest"]].append(r)
    want = {warc.base32_sha1((h or "").encode()): [p for p, _, x in PAGES if (x or "") == (h or "")] for _, _, h in PAGES}
    assert set(by) == set(want)
    for digest, ids in want.items():
        response = [r for r in by[digest] if r["record_type"] == "response"]
        best = max(i for i in ids if i is not None)
        assert len(response) == 1 and response[0]["page_id"] == best and response[0]["refers_to"] is None
        assert all(r["refers_to"] == best for r in by[digest] if r["record_type"] == "revisit")
        assert sorted((r["page_id"] or -1) for r in by[digest]) == sorted((i or -1) for i in ids)
    assert spark.read.parquet(archive.payloads).count() == len(want)
    records = warc.records(spark, archive).collect()
    for r in records:
        head = warc.parse_header(bytes(r["header"]))
        body = bytes(r["record"])[len(r["header"]) : -4]
        assert len(body) == int(head["Content-Length"])
        assert warc.base32_sha1(bytes(r["payload"])) == head["WARC-Payload-Digest"][5:]
        assert body == (b"" if head["WARC-Type"] == "revisit" else bytes(r["payload"]))


def test_archive_threshold_and_empty(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.read_index(spark, warc.write_archive(pages, min_dedup_bytes=100)).collect()
    assert {r["record_type"] for r in rows} == {"response"}
    assert warc.read_index(spark, warc.write_archive(pages.limit(0))).count() == 0


# -- neighbours -----------------------------------------------------------------------------


def brute(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows]
    out = {}
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        v = min((tuple(x) for i, x in good if i == q))
        scored = sorted((-float(np.dot(x, np.array(v))), i) for i, x in good if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def ask(spark, rows, k=20, kind="float", shard_rows=60, **options):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("shard", F.lit("clash"))
    used, dim = ann.usable(table.repartition(2))
    queries = used.filter("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    got = defaultdict(list)
    for r in sorted(ann.search(ann.index(used, dim, shard_rows), queries, k, **options).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall_of(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(len(v) for v in want.values())


def test_neighbours_of_odd_vectors(spark):
    rows = [(i, [float(i % 5), 1.0, float(-i)]) for i in range(45)] + [(100 + i, [1.0, 1.0, 1.0]) for i in range(120)]
    rows += [(40, [1.0, 1.0, 1.0]), (3, [3.0, 1.0, -3.0])]
    bad = [(60, None), (80, [0.0, 0.0, 0.0]), (200, [1.0, None, 2.0]), (220, [float("nan"), 1.0, 1.0]), (240, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (260, [1.0, 2.0]), (280, [])]
    rows32 = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got, want = ask(spark, rows + bad), brute(rows32, 20)
    assert set(got) == set(want)
    assert recall_of(got, want) > 0.9
    for q, found in got.items():
        assert all(i != q for i, _ in found) and len(found) == 20
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_few_and_no_vectors(spark):
    assert ask(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]) == {0: [(1, 0.5), (2, 0.0)]}
    assert ask(spark, [(0, [1.0, 0.0])]) == {}
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    used, dim = ann.usable(table)
    assert ann.search(ann.index(used, dim), used).count() == 0


def test_doubles_keep_their_values(spark):
    """Scores are of doubles that no float can hold, and vectors beyond the range of floats take part."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(200, 6)) * np.where(np.arange(200) % 7 == 0, 1e150, 1.0 + 1e-12)[:, None])]
    got, want = ask(spark, rows, kind="double"), brute(rows, 20)
    assert set(got) == set(want) and recall_of(got, want) > 0.95
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12) for q in got for i, s in got[q] if (q, i) in exact)


def norms(kind, n, rng):
    return {"alike": 1.0, "uniform": rng.uniform(0.5, 2, size=(n, 1)), "tailed": np.exp(rng.normal(0, 0.5, size=(n, 1)))}[kind]


@pytest.mark.parametrize("kind", ["alike", "uniform", "tailed"])
def test_recall_of_a_full_shard(kind):
    rng = np.random.default_rng(3)
    n = ann.SHARD_ROWS
    x = (rng.normal(size=(n, 64)) * norms(kind, n, rng)).astype(np.float32)
    shard = ann.unpack(ann.pack(np.arange(n), x, 16, 64), 64, 16, np.float32)
    asked = np.arange(0, n, 80)
    q, found, _ = ann.shard_best(shard, asked, x[asked], 20, 192)
    exact = x[asked].astype(np.float64) @ x.T.astype(np.float64)
    exact[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-exact, axis=1)[:, :20]
    pairs = set(zip(q.tolist(), found.tolist(), strict=True))
    assert np.mean([[(int(a), int(b)) in pairs for b in row] for a, row in zip(asked, best, strict=True)]) > 0.95


def test_routing_to_cells(spark):
    """Vectors around twelve directions with different norms, a third of all rows equal: routed queries ask few cells, and
    find what all cells give."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(12, 16))
    x = centre[rng.integers(0, 12, 2000)] + 0.2 * rng.normal(size=(2000, 16))
    x *= np.where(rng.uniform(size=(2000, 1)) < 0.2, 3.0, 1.0)
    x = np.concatenate([x, np.repeat(x[:1], 1000, axis=0)]).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    made = ann.index(table, 16, shard_rows=150)
    sizes = [len(np.frombuffer(r["ids"], np.int64)) for r in made.graphs.select("ids").collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300 and len(made.centres) > 4
    assert ann.cells_needed(made, table.filter("vec_id % 20 = 0"), 20, 192, 0.99, 64) < len(made.centres)
    want = brute(rows, 20)
    got = ask(spark, rows, shard_rows=150)
    every = ask(spark, rows, shard_rows=150, recall=None)
    tied = lambda g: np.mean([sum(s >= want[q][-1][1] - 1e-9 for _, s in g[q]) / 20 for q in want])
    assert tied(got) > 0.95 and tied(every) > 0.97


# -- near copies ----------------------------------------------------------------------------


def near_brute(docs, count=False):
    """(id, class by smallest id) over all pairs, or the number of classes."""
    h = [orderminhash.labelled(orderminhash.words_of(t)) for _, t in docs]
    at = list(range(len(docs)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if orderminhash.similarity(h[i], h[j], 0.8) > 0:
            at[top(i)] = top(j)
    if count:
        return len({top(i) for i in range(len(docs))})
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, least.get(top(i))) for i, (d, _) in enumerate(docs))


def copies(seed, n, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((6, 12, 30, 45, 80, 200)))] for _ in range(12)]
    docs = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice(([rng.choice(vocabulary)], [], [words[k], "x"]))
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize(("seed", "n", "edits", "large"), [(1, 250, 4, 64), (2, 250, 9, 4)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, n, edits, large):
    monkeypatch.setattr(orderminhash, "LARGE", large)
    docs = copies(seed, n, edits)
    got = orderminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert Counter((r["doc_id"], r["class_id"]) for r in got.collect()) == near_brute(docs)


def test_classes_of_odd_rows(spark):
    docs = odd.table(spark).withColumn("uid", F.lit("clash")).withColumn("words", F.lit("w")).withColumn("class_id", F.lit(1))
    rows = orderminhash.near_duplicates(docs, keep=True).collect()
    assert {(r["uid"], r["words"]) for r in rows} == {("clash", "w")}
    assert len(rows) == len(odd.rows())
    assert sum(r["stays"] for r in rows) == near_brute([r[:2] for r in odd.rows()], count=True)
    assert Counter((r["doc_id"], r["class_id"]) for r in rows) == near_brute([r[:2] for r in odd.rows()])
    empties = {r["class_id"] for r in rows if r["doc_id"] in (7, 200, 201, 202)}
    assert len(empties) == 1
    assert orderminhash.near_duplicates(odd.empty(spark)).count() == 0


def cut_copy(alone):
    """A text of 28 shingles (0) that is a text of 35 (1) cut by a fifth, similar by exactly 0.8; others begin like both, in ten
    groups, whose members head all of their common buckets, those with more than LARGE members."""

    def run(name, n):
        return [f"s2{name}x{i}" for i in range(n)]

    texts = [run("c", 32), run("c", 32) + run("v", 7)]
    if not alone:
        texts += [run("c", 32) + run(f"h{i}y", 15) + run(f"o{i}z{j}y", 2) for i in range(10) for j in range(24)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_cut_copy_in_large_buckets(spark):
    docs = cut_copy(False)
    got = orderminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    found = {r["doc_id"]: r["class_id"] for r in got.collect()}
    assert found[1] == found[0] == 0
    assert Counter(found.items()) == near_brute(docs)


def test_cut_copy_with_rare_shingles(spark):
    table = orderminhash.prepared(spark.createDataFrame(cut_copy(True), "doc_id long, text string"))
    held = table.select("uid", F.col("uid").alias("comp"))
    _, pairs = orderminhash._in_large_buckets(held, table.select("uid", "n"), table.select("uid", "words"), 0.8)
    assert pairs.count() == 1


def test_template_pages_are_hardly_aligned(spark, monkeypatch):
    """Pages of six blocks with five variants each share most sketches with many others, and none is a near copy: alignments stay few."""
    rng, aligned = random.Random(1), []
    blocks = [[" ".join(f"s{i}v{v}w{j}" for j in range(20)) for v in range(5)] for i in range(6)]
    real = orderminhash.written

    def counted(df, name, *a):
        out = real(df, name, *a)
        aligned.append(out.count() if name == "omh-pairs" else 0)
        return out

    monkeypatch.setattr(orderminhash, "written", counted)
    docs = list(enumerate(sorted({" ".join(rng.choice(b) for b in blocks) for _ in range(1000)})))
    docs += [(5000 + i, t + f" tail{i}") for i, t in docs[:300:10]]
    got = orderminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {d: d - 5000 if d >= 5000 else d for d, _ in docs}
    assert sum(aligned) < 2 * len(docs)


def test_bins_accept_links():
    """Pairs at 0.8 or just above are never rejected by their bins; most at 0.5 are."""
    rng = np.random.default_rng(0)
    passed = 0
    for n in (5, 9, 18, 45, 90, 450, 2000):
        for _ in range(300):
            total = n + n // 4
            h = orderminhash.mixed(rng.integers(0, 2**62, total, np.int64).astype(np.uint64), 1)
            assert accepted(h[:n], h[:total] if n / total >= 0.8 else h[:n])
            far = orderminhash.mixed(rng.integers(0, 2**62, 2 * n, np.int64).astype(np.uint64), 1)
            passed += n >= 90 and accepted(far[: n + n // 2], far[n // 2 :])
    assert passed < 30


def accepted(a, b):
    x, y = (orderminhash.binned(h).view(np.uint8) for h in (a, b))
    used = int(((x > 0) | (y > 0)).sum())
    return int(((x == y) & (x > 0)).sum()) >= 0.8 * used - orderminhash.DEVIATIONS * 0.4 * used**0.5 - 1


def test_one_text_in_many_rows(spark):
    """A third of all rows is one text, another third near copies of one: keys with many rows are sent, the others shuffled."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(100)]
    docs = [(i, t) for i, t in enumerate([" ".join(base[::-1])] * 100 + near + [" ".join(f"u{i}x{j}" for j in range(12)) for i in range(100)])]
    for keys in (1, 3, 100_000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(common, "SENT_KEYS", keys)
            got = orderminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
            assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in got.collect()} == {i: (0, 100) if i < 100 else (100, 100) if i < 200 else (i, 1) for i, _ in docs}


def test_order_matters():
    words = [f"w{i}" for i in range(100)]
    a, b = (orderminhash.labelled(orderminhash.words_of(" ".join(w))) for w in (words, words[50:] + words[:50]))
    assert len(set(a.tolist()) & set(b.tolist())) > 80
    assert orderminhash.similarity(a, b, 0.8) == 0.0 and orderminhash.similarity(a, a, 0.8) == 1.0


def test_longest_rise():
    rng = random.Random(1)
    for _ in range(200):
        x = list(range(rng.randrange(9)))
        rng.shuffle(x)
        want = max((len(c) for n in range(len(x) + 1) for c in itertools.combinations(x, n) if list(c) == sorted(c)), default=0)
        assert orderminhash.longest_rise(np.array(x, np.int64)) == want


# -- lines ----------------------------------------------------------------------------------


def lines_brute(rows, least):
    sites, first = defaultdict(set), {}
    keys = [hashlib.md5(f"{'null' if d is None else d}|{t or ''}".encode()).digest() for d, t, *_ in rows]
    for (d, t, _, s, _), key in zip(rows, keys, strict=True):
        for pos, line in enumerate(t.split("\n") if t is not None else ()):
            if bare := line.strip(" "):
                sites[bare].add(s)
                at = (d is None, d or 0, key, pos)
                first[bare] = min(first.get(bare, at), at)
    out = []
    for (d, t, *_), key in zip(rows, keys, strict=True):
        kept, total = [], 0
        for pos, line in enumerate(t.split("\n") if t is not None else ()):
            bare = line.strip(" ")
            total += bool(bare)
            if not bare or len(sites[bare]) < least or first[bare] == (d is None, d or 0, key, pos):
                kept.append(line)
        out.append((d, None if t is None else "\n".join(kept), total))
    return Counter(out)


@pytest.mark.parametrize("sent", [1000, 0])
def test_lines(spark, sent):
    rng = random.Random(2)
    rows = odd.rows() + [(300 + i, "\n".join(rng.choice(["a", "b ", " c", "d", "", "e"]) for _ in range(5)), None, rng.choice(["s0", "s1", "s2", "s3", None]), 1) for i in range(60)]
    docs = spark.createDataFrame(rows, odd.SCHEMA).repartition(3).withColumn("n_removed", F.lit("clash"))
    got = linededup.drop_lines(docs, linededup.boilerplate(docs, min_sites=3), sent_lines=sent)
    assert Counter((r["doc_id"], r["text"], r["n_lines"]) for r in got.collect()) == lines_brute(rows, 3)
    none = odd.empty(spark)
    assert linededup.drop_lines(none, linededup.boilerplate(none), sent_lines=sent).count() == 0


@pytest.mark.parametrize("sent", [1000, 0])
def test_long_and_frequent_lines(spark, monkeypatch, sent):
    """Lines of a hundred thousand characters, with carriage returns, and one that is a third of all; few keys are sent."""
    monkeypatch.setattr(common, "SENT_KEYS", 2)
    rng, long = random.Random(4), "x y " * 25_000
    pool = ["often"] * 6 + [long, long + "z", "cr\r", "cr", "tab\t", *[f"rare {i}" for i in range(9)]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(4)), None, f"s{i % 5}", 1) for i in range(80)]
    docs = spark.createDataFrame(rows, odd.SCHEMA).repartition(3)
    got = linededup.drop_lines(docs, linededup.boilerplate(docs, min_sites=4), sent_lines=sent)
    assert Counter((r["doc_id"], r["text"], r["n_lines"]) for r in got.collect()) == lines_brute(rows, 4)


# -- pipeline -------------------------------------------------------------------------------


def test_stages(spark):
    docs = odd.table(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix", "bpe"]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "bpe":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        rows = docs.collect()
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    with_letters = sum(any(c.isalpha() for c in t or "") for _, t, *_ in odd.rows())
    assert counts[0] == with_letters and counts[1] <= counts[0] and counts[2] < counts[1] and counts[4] == counts[3]
    empty = odd.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0
        empty = spark.createDataFrame([], out.schema)


def test_near_copy_stage_equals_brute_force(spark):
    docs = [(i, t, "en", "s", len(t)) for i, t in copies(5, 120, 4)]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, odd.SCHEMA), "").collect()
    want = {c for _, c in near_brute([d[:2] for d in docs])}
    assert {r["doc_id"] for r in left} == want


def test_language_stage_equals_one_by_one(spark):
    docs = odd.table(spark)
    left = corpus_pipeline.identify_language(spark, docs, "").collect()
    net = langid.train(langid.sample(docs.filter(common.id_remainder(F.col("doc_id"), 3) != 1)))
    want = Counter()
    for d, t, _, source, n in odd.rows():
        if any(map(str.isalpha, t or "")):
            p = net.documents([t.encode()])[0]
            if p.max() >= 1 / 3:
                want[d, t, net.languages[int(p.argmax())], source, n] += 1
    assert Counter(tuple(r) for r in left) == want


def test_line_stage_equals_brute_force(spark):
    rng = random.Random(8)
    pool = ["Terms of use", "All rights reserved", "Share this", *[f"text {i}" for i in range(200)]]
    rows = [(i, "\n".join(rng.choice(pool[:3] if rng.random() < 0.3 else pool) for _ in range(rng.randint(1, 6))), "en", f"s{i % 14}", None) for i in range(200)]
    left = corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, odd.SCHEMA).repartition(3), "").collect()
    want = Counter()
    for (d, kept, total), (_, t, *_) in zip(sorted(lines_brute(rows, 10).elements()), rows, strict=True):
        gone = t.count("\n") - (kept.count("\n") if kept else -1)
        if not gone or gone < total:
            want[d, kept, len(kept) if gone else None] += 1
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in left) == want


def test_mix_stage_equals_plain_computation(spark):
    docs = odd.table(spark)
    want, _ = plainly(spark, docs, mix.SHARD_WORDS, mix.BLOCK_WORDS)
    left = corpus_pipeline.mix_sources(spark, docs, "")
    times = Counter((r["doc_id"], r["source"], r["th"]) for r in left.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    expected = Counter()
    for (d, source, th, draws), n in want.items():
        expected[d, source, th] += n * len(draws)
    assert times == +expected


def test_encode_stage_equals_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    rows = odd.rows()
    left = corpus_pipeline.encode(spark, odd.table(spark), "").collect()
    want = Counter()
    for d, t, lang, source, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, source, lang, tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["source"], r["lang"], tuple(r["ids"]), r["decoded_sha256"]) for r in left) == want


def test_working_tables_go_with_their_run(spark):
    """A stage's tables stay while an earlier stage runs, or a later one that reads them, and go with a later one that doesn't."""
    docs = odd.table(spark)
    held = corpus_pipeline.drop_near_copies(spark, docs, "")
    corpus_pipeline.identify_language(spark, docs, "")
    paths = next(made for name, made in corpus_pipeline._LEFT.get() if name == "drop_near_copies")
    assert held.count() > 0
    corpus_pipeline.mix_sources(spark, held, "").collect()
    assert held.count() > 0
    corpus_pipeline.encode(spark, docs, "")
    assert paths and not any(exists(spark, p) for p in paths)


def test_no_shared_folder_on_a_cluster(spark):
    class Away:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_path(Away, "x")
