"""The twelve unit tests of the method's core, and brute-force checks of the kernels."""

import itertools
import math
import random
import time
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cdrspark.functions import constants as C
from cdrspark.functions import costs, sequences, stats
from cdrspark.operators import filters, kmers, simjoin
from cdrspark.operators.clusters import score
from cdrspark.sources import reference
from tests.mock import SCHEMA, contigs


def test_mock_structure(spark):
    rows = contigs(spark)
    assert {"cell_id", "chain_type", "cdr3_aa", "v_gene", "clone_id"} <= set(rows.columns)
    assert {r[0] for r in rows.select("chain_type").distinct().collect()} == {"heavy", "light"}


def test_filter(spark):
    bad = spark.createDataFrame([("bad_cell", "S1", "IGH", "heavy", "IGHV1-1", None, "IGHJ1", None, "CX", None, "c", True, True, 999)], SCHEMA)
    kept = filters.filter_contigs(contigs(spark).unionByName(bad))
    assert kept.filter("cell_id = 'bad_cell'").count() == 0
    assert kept.filter("cdr3_aa like '%X%'").count() == 0


def test_cost_matrix():
    m = costs.cost_matrix()
    assert len(m) == 400
    assert all(m[a, a] == 0 for a in C.AMINO_ACIDS)
    assert all(m[a, b] == m[b, a] for a, b in m)
    pairs = [m[a, b] for a, b in itertools.combinations(C.AMINO_ACIDS, 2)]
    assert (pairs.count(0.0), pairs.count(0.5), pairs.count(1.0)) == (21, 25, 144)


def test_costs_follow_from_scores():
    text = "# made up\n   A  R  N\nA  4 -1  1\nR -1  5  0\nN  1  0  6\n"
    scores = costs.read_score_matrix(text)
    assert scores["A", "A"] == 4
    assert costs.costs_of(scores) == {("A", "A"): 0, ("A", "R"): 1, ("A", "N"): 0, ("R", "A"): 1, ("R", "R"): 0, ("R", "N"): 0.5, ("N", "A"): 0, ("N", "R"): 0.5, ("N", "N"): 0}


def test_distance_identity():
    assert costs.weighted("CARDGY", "CARDGY") == 0


def test_distance_order():
    assert costs.weighted("CARDGY", "CARDSY") == 0.5
    assert costs.weighted("CARDGY", "CARDWY") == 1


def test_kmers(spark):
    rows = spark.createDataFrame([("ABCDEF",), ("GHIJKL",), ("ABC",), (None,)], "s string").select(sequences.kmers(F.col("s"), 4)).collect()
    assert rows[0][0] == ["ABCD", "BCDE", "CDEF"]
    assert rows[2][0] == [] and rows[3][0] == []


def test_collapse_does_not_grow(spark):
    rows = contigs(spark)
    assert filters.collapse_clones(rows).count() <= rows.count()


def test_chain_names(spark):
    rows = spark.createDataFrame([("IGH",), ("Heavy",), ("IGK",), ("Lambda",)], "c string").select(sequences.standardise_chain(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["IGH", "IGH", "IGK", "IGL"]


def test_synthetic_reference(spark):
    rows = reference.synthetic_sequences(spark, 1000)
    assert rows.count() == 1000
    assert rows.filter("cdr3_aa rlike '^C.*W$' and v_gene rlike '^IGHV' and length(cdr3_aa) between 8 and 25").count() == 1000
    assert rows.select("cdr3_aa").distinct().count() > 900


def test_kmer_frequencies(spark):
    rows = spark.createDataFrame([("CARDGYSSGWY",), ("CAREVVAAGTDY",), ("CARDGYSSGWF",), ("CXYZABCDEFGW",)], "cdr3_aa string")
    found = {r["kmer"]: r for r in kmers.background_frequencies(rows, (4,)).collect()}
    assert found["CARD"]["count"] == 2 and found["CARD"]["per_seq"] == 0.5
    assert found["CARD"]["n_total"] == 4
    assert math.isclose(sum(r["freq"] for r in found.values()), 1)


def test_score_range(spark):
    rows = spark.createDataFrame([(3, 1.0, 0.5, 0.01, 0.5), (10, 0.8, 1.0, 0.001, 1.0), (50, 0.5, 0.2, 0.5, 3.0)], "n long, c double, s double, p double, d double")
    for (x,) in rows.select(score(*[F.col(c) for c in "ncspd"])).collect():
        assert 0 <= x <= 1


def test_no_edges_have_their_columns(spark):
    empty = contigs(spark).limit(0)
    for chain in ("heavy", "paired"):
        edges = simjoin.global_edges(empty, chain=chain)
        assert edges.count() == 0
        assert edges.columns == ["seq_id_1", "seq_id_2", "cdr3_1", "cdr3_2", "distance", "chain"]


# -- beyond the twelve ----------------------------------------------------------------------


def test_kernel_matches_definition():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ARDGSTWYVX") for _ in range(rng.randint(0, 9)))
    a, b = [word() for _ in range(3000)], [word() for _ in range(3000)]
    found = costs.distances(pa.array(a, pa.string()), pa.array(b, pa.string()))
    want = [costs.weighted(x, y) if len(x) == len(y) else costs.gapped(x, y) for x, y in zip(a, b, strict=True)]
    assert np.array_equal(found, want)


@pytest.mark.parametrize("scoring", ["weighted", "hamming"])
@pytest.mark.parametrize("budget", [0.0, 0.5, 1.0, 2.0])
def test_join_matches_all_pairs(spark, scoring, budget):
    rng = random.Random(3)
    base = ["".join(rng.choice("ARDGSTWYVKMILE") for _ in range(n)) for n in (*(rng.randint(5, 13) for _ in range(10)), 24, 35)]
    seqs = set(base)
    while len(seqs) < 160:
        s = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            s[rng.randrange(len(s))] = rng.choice("ARDGSTWYVKX")
        if rng.random() < 0.4:
            del s[rng.randrange(len(s))]
        seqs.add("".join(s))
    rows = [(i, f"c{i}", s) for i, s in enumerate(sorted(seqs))]
    got = simjoin.similar_pairs(spark.createDataFrame(rows, "ord long, seq_id string, seq string"), budget, scoring).collect()
    want = {}
    for (i, _, a), (j, _, b) in itertools.combinations(rows, 2):
        if scoring == "hamming":
            d = sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else math.inf
        else:
            d = costs.weighted(a, b) if len(a) == len(b) else costs.gapped(a, b)
        if d <= budget:
            want[i, j] = d
    assert len(got) == len(want)
    assert {(r["ord_1"], r["ord_2"]): r["distance"] for r in got} == want


def test_free_residues_share_one_block():
    """residues that match at no cost share exactly one block, others none, so few spellings of a segment find each pair once
    (before: every string that a segment matches, up to 4 to the power of 7)."""
    letters = [chr(c) for c in range(33, 97)]
    for a, b in itertools.product(letters, letters):
        assert len({*costs.BLOCKS_OF[0].get(a, a)} & {*costs.BLOCKS_OF[1].get(b, b)}) == (costs.COSTS[ord(a), ord(b)] == 0)
    assert len(simjoin.segment_keys("CKEKQEKILVMIWYW", 0.5, "weighted", 1, False)) < 2000


def test_keys_are_not_sent_through_the_driver(spark):
    """a sequence has many more bytes of keys than it has itself, so no side of the join is broadcast, however small it looks."""
    seqs = spark.createDataFrame([(1, "a", "CARDGYSSGWYW"), (2, "b", "CARDGYSSGWYF")], "ord long, seq_id string, seq string")
    pairs = simjoin.similar_pairs(seqs, 0.5)
    assert pairs.count() == 1 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_masked_tokens_match_patterns(spark):
    rows = contigs(spark).filter("chain_type = 'heavy'")
    seqs = kmers.tested_sequences(rows, ("heavy",), (4,))
    found = kmers.motif_rows(seqs, (4,))
    exact = kmers.candidates(found, kmers.totals_of(seqs), 2, 1.0)
    tokens = kmers.degenerate_motifs(exact, (4,))
    held = {(r["token"], r["row"]) for r in kmers.degenerate_rows(found, tokens, (4,)).collect()}
    pattern = seqs.crossJoin(tokens.select("token")).filter("cdr3_aa rlike token")
    assert held == {(r["token"], r["row"]) for r in pattern.collect()}


def test_tails_match_sums():
    for x, n, p in ((0, 5, 0.1), (3, 50, 0.001), (40, 50, 0.5), (50, 50, 0.9), (7, 2000, 0.002)):
        q = Fraction(p)
        want = float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(x, min(n, x + 60) + 1)))
        assert math.isclose(stats.binomial_tail(x, n, p), want, rel_tol=1e-9)
    for a, draws, good, total in ((2, 5, 6, 20), (5, 5, 6, 20), (0, 3, 4, 9), (3, 10, 15, 400)):
        whole = math.comb(total, draws)
        want = sum(math.comb(good, i) * math.comb(total - good, draws - i) for i in range(a, min(draws, good) + 1)) / whole
        assert math.isclose(stats.hypergeometric_tail(a, draws, good, total), want, rel_tol=1e-9)


def test_equal_tests_are_summed_once(monkeypatch):
    """Before, each of equal tests had a sum of its own."""
    calls, tail = [], stats.binomial_tail
    monkeypatch.setattr(stats, "binomial_tail", lambda *x: calls.append(x) or tail(*x))
    rows = [(3, 50, 0.01), (4, 50, 0.01), (3, 50, 0.02)] * 300
    found = stats.binomial_p.func(*map(pd.Series, zip(*rows, strict=True)))
    assert len(calls) == 3 and found.tolist() == [tail(*r) for r in rows]


@pytest.mark.parametrize("deal", [1, 4])
def test_dealt_join_finds_the_same_edges(spark, deal):
    rng = random.Random(8)
    seqs = {"CARD" + "".join(rng.choice("ADE") for _ in range(6)) + "W" for _ in range(120)}
    rows = spark.createDataFrame([(f"c{i}", "heavy", s, i) for i, s in enumerate(sorted(seqs))], "cell_id string, chain_type string, cdr3_aa string, ord long")
    for scoring in ("hamming", "weighted"):
        edges = [sorted(map(tuple, simjoin.global_edges(rows, scoring=scoring, deal=d).collect())) for d in (0, deal)]
        assert edges[0] == edges[1] and len(edges[0]) > 100


def test_hommel_by_closed_testing():
    rng = np.random.default_rng(2)
    for p in (rng.uniform(size=6) ** 2, rng.uniform(size=7) ** 6, np.round(rng.uniform(size=7), 1), np.zeros(3), np.array([0.03]), np.array([])):
        found, n = stats.hommel(p), len(p)
        for i in range(n):
            worst = 0.0
            for size in range(1, n + 1):
                for group in itertools.combinations(range(n), size):
                    if i in group:
                        s = np.sort(p[list(group)])
                        worst = max(worst, min(size * s[k] / (k + 1) for k in range(size)))
            assert math.isclose(found[i], min(1, worst), rel_tol=1e-12, abs_tol=1e-300)


def test_adjusted_equals_sorted_definitions(spark):
    rng = np.random.default_rng(5)
    p = np.r_[np.round(rng.uniform(size=300) ** 3, 2), 0.0, 0.0, 1.0, rng.uniform(size=40) * 1e-6]
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "id long, p double").repartition(5)
    n, order = len(p), np.argsort(p, kind="stable")
    s, rank = p[order], np.arange(1, n + 1)
    up, down = np.maximum.accumulate, lambda x: np.minimum.accumulate(x[::-1])[::-1]
    want = {
        "none": s, "bonferroni": n * s, "holm": up((n - rank + 1) * s), "hochberg": down((n - rank + 1) * s),
        "BH": down(n * s / rank), "BY": down((1 / rank).sum() * n * s / rank), "hommel": by_levels(s),
    }
    for method, values in want.items():
        got = {r["id"]: r["adj"] for r in stats.adjusted(rows, "p", method, "adj", ["id"]).collect()}
        assert np.allclose([got[i] for i in order.tolist()], np.minimum(values, 1), rtol=1e-12, atol=0), method
    empty = rows.limit(0)
    assert all(stats.adjusted(empty, "p", m, "adj", ["id"]).count() == 0 for m in stats.METHODS)
    with pytest.raises(ValueError):
        stats.adjusted(rows, "p", "hommel", "adj", ["id"], most_tests=10)


def by_levels(s):
    """Hommel's values from the smallest ratio for every number of kept tests, without hulls and crossings."""
    n = len(s)
    bound = [min(j * s[n - j + k - 1] / k for k in range(1, j + 1)) for j in range(1, n + 1)]
    return np.array([max(min(bound[j - 1], j * x) for j in range(1, n + 1)) for x in s])


def test_kmers_of_repeats(spark):
    """Occurrences count each place, shares each sequence once."""
    rows = spark.createDataFrame([("CARDCARDW",), ("AAAAAAA",), ("CARDW",), ("CAR",), (None,)], "cdr3_aa string")
    found = {(r["k"], r["kmer"]): (r["count"], round(r["per_seq"] * 3), r["n_total"]) for r in kmers.background_frequencies(rows, (4, 5)).collect()}
    assert found[4, "CARD"] == (3, 2, 3) and found[4, "AAAA"] == (4, 1, 3) and found[5, "AAAAA"] == (3, 1, 3) and found[5, "CARDW"] == (2, 2, 3)


def test_adjusting_many_tests_in_one_part(spark):
    """A frame up to the end of a part took time with the square of its rows: minutes for these."""
    rows = spark.range(60_000).selectExpr("id", "(id * 7919 % 60000 + 1) / 60000.0D as p")
    began = time.time()
    (row,) = stats.adjusted(rows, "p", "BH", "adj", ["id"]).agg(F.min("adj"), F.max("adj"), F.count("*")).collect()
    assert row[0] == pytest.approx(1.0) and row[2] == 60_000 and time.time() - began < 60


def test_paired_edges_match_all_pairs(spark, monkeypatch):
    """Many cells of few heavy CDR3s, in blocks of three."""
    monkeypatch.setattr(simjoin, "BLOCK", 3)
    rng, rows = random.Random(3), []
    some = lambda n: "".join(rng.choice("ASTDENKRILVF") for _ in range(n))
    heavies, lights = ["CA" + some(n) + "W" for n in (4, 4, 5, 5, 6)], ["C" + some(n) + "F" for n in (3, 3, 4, 4, 5)]
    change = lambda s: s if rng.random() < 0.4 else (lambda i: s[:i] + rng.choice("ASTDEN") + s[i + 1 :])(rng.randrange(1, len(s) - 1))
    for i in range(120):
        for kind, pool in (("heavy", heavies), ("light", lights), *((("heavy", heavies),) if i % 20 == 0 else ())):
            rows.append((f"c{i:03}", kind, change(rng.choice(pool)), len(rows)))
    cells = [(h[3], g[3], h[0], h[2], g[2]) for h in rows for g in rows if h[0] == g[0] and h[1] == "heavy" and g[1] == "light"]
    far = lambda a, b: costs.weighted(a, b) if len(a) == len(b) else costs.gapped(a, b)
    expected = []
    for a, b in itertools.combinations(sorted(cells), 2):
        d = 0.7 * far(a[3], b[3]) + 0.3 * far(a[4], b[4])
        if d <= 1.0:
            expected.append((a[2], b[2], f"{a[3]}|{a[4]}", f"{b[3]}|{b[4]}", round(d, 9), "paired"))
    found = simjoin.paired_edges(spark.createDataFrame(rows, "cell_id string, chain_type string, cdr3_aa string, ord long"), 1.0)
    assert sorted((*r[:4], round(r[4], 9), r[5]) for r in found.collect()) == sorted(expected) and len(expected) > 100
