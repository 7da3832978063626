"""Enriched local motifs: exact and degenerate candidates, tail tests, correction, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdrspark.functions.constants import KMER_SIZES, MAX_FRACTION, MIN_COUNT, MIN_FOLD, P_CUTOFF
from cdrspark.functions.stats import adjusted, binomial_p
from cdrspark.operators import kmers as K
from cdrspark.operators.tables import written

CHAINS = {"heavy": ("heavy",), "light": ("light",), "both": ("heavy", "light")}
#: Columns of a motif table, member_ids aside.
TESTED = ("motif", "k", "chain", "count_obs", "freq_obs", "freq_ref", "fold_enrichment", "pvalue")


def _tested(df: DataFrame) -> DataFrame:
    """Observed share, fold and upper tail from count_obs, n_input, freq_ref."""
    df = df.withColumn("freq_obs", F.col("count_obs") / F.col("n_input"))
    df = df.withColumn("fold_enrichment", F.col("freq_obs") / F.greatest("freq_ref", F.lit(1e-10)))
    return df.withColumn("pvalue", binomial_p("count_obs", "n_input", F.greatest("freq_ref", F.lit(1e-10))))


def _sizes(background: DataFrame) -> DataFrame:
    """k and n_total: one row for each k that the background has; other k are not tested. Spark broadcasts it if it is small."""
    return background.groupBy("k").agg(F.max("n_total").alias("n_total"))


def exact_tests(found: DataFrame, background: DataFrame) -> DataFrame:
    """Tests of exact candidates; a k-mer that the background lacks counts as seen in one sequence."""
    known = background.select("k", "kmer", "per_seq")
    joined = found.join(_sizes(background), "k").join(known, ["k", "kmer"], "left")
    joined = joined.withColumn("freq_ref", F.coalesce("per_seq", F.lit(1.0) / F.col("n_total")))
    return _tested(joined.withColumnRenamed("kmer", "motif")).select(*TESTED)


def degenerate_tests(found: DataFrame, background: DataFrame, k_sizes: Sequence[int] = KMER_SIZES) -> DataFrame:
    """Tests of degenerate candidates against the summed background, 0.99 at most."""
    sums = K.degenerate_background(background, found, k_sizes)
    joined = found.join(_sizes(background), "k").join(sums, ["k", "token"], "left")
    ref = F.when(F.col("bg") > 0, F.col("bg")).otherwise(F.lit(1.0) / F.col("n_total"))
    return _tested(joined.withColumn("freq_ref", F.least(ref, F.lit(0.99))).withColumnRenamed("token", "motif")).select(*TESTED)


def motif_tests(contigs: DataFrame, background: DataFrame, chain: str = "heavy", k_sizes: Sequence[int] = KMER_SIZES, min_count: int = MIN_COUNT, max_fraction: float = MAX_FRACTION, degenerate: bool = True) -> tuple[DataFrame, DataFrame]:
    """All tests, with kind (exact or degenerate); and members (kind, chain, k, motif, row, cell_id) of all candidates."""
    sequences = K.tested_sequences(contigs, CHAINS[chain], k_sizes)
    totals, rows = K.totals_of(sequences), K.motif_rows(sequences, k_sizes)
    # Tests, masked tokens and their totals all read the candidates.
    exact = written(K.candidates(rows, totals, min_count, max_fraction), "candidates")
    tests = exact_tests(exact, background).withColumn("kind", F.lit("exact"))
    members = rows.select(F.lit("exact").alias("kind"), "chain", "k", F.col("kmer").alias("motif"), "row", "cell_id")
    if degenerate:
        tokens = K.degenerate_motifs(exact, k_sizes)
        held = K.degenerate_rows(rows, tokens, k_sizes)
        found = K.degenerate_candidates(held, totals, min_count, max_fraction)
        tests = tests.unionByName(degenerate_tests(found, background, k_sizes).withColumn("kind", F.lit("degenerate")))
        members = members.unionByName(held.select(F.lit("degenerate").alias("kind"), "chain", "k", F.col("token").alias("motif"), "row", "cell_id"))
    return tests, members


def significant(tests: DataFrame, method: str = "BH", p_cutoff: float = P_CUTOFF, min_fold: float = MIN_FOLD) -> DataFrame:
    """Tests with pvalue_adj (over all of them together) that pass both bounds."""
    out = adjusted(tests, "pvalue", method, "pvalue_adj", ["kind", "chain", "k", "motif"])
    return out.filter((F.col("pvalue_adj") < p_cutoff) & (F.col("fold_enrichment") >= min_fold))


def members_of(kept: DataFrame, members: DataFrame) -> DataFrame:
    """Members (kind, chain, k, motif, row, cell_id) of the kept motifs, as rows."""
    return members.join(kept.select("kind", "chain", "k", "motif"), ["kind", "chain", "k", "motif"], "left_semi")


def with_member_ids(motifs: DataFrame, members: DataFrame) -> DataFrame:
    """motifs with member_ids, the array of each one's cells in row order. A motif has up to max_fraction of all contigs, so this
    is for export and for callers who want arrays; everything else works on the members as rows."""
    key = ["kind", "chain", "k", "motif"]
    ids = members.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "cell_id"))), lambda x: x["cell_id"]).alias("member_ids"))
    return in_order(motifs.join(ids, key))


def in_order(motifs: DataFrame) -> DataFrame:
    """Most significant first."""
    return motifs.orderBy("pvalue_adj", "kind", "chain", "k", "motif")


def enriched_motifs(contigs: DataFrame, background: DataFrame, p_adjust_method: str = "BH", p_cutoff: float = P_CUTOFF, min_fold: float = MIN_FOLD, **options) -> DataFrame:
    """The motif table: TESTED, pvalue_adj and member_ids, most significant first."""
    tests, members = motif_tests(contigs, background, **options)
    kept = written(significant(tests, p_adjust_method, p_cutoff, min_fold), "motifs")
    return with_member_ids(kept, members_of(kept, members))
