"""k-mer counts of a background and of contigs, exact and with one degenerate position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdrspark.functions.constants import KMER_SIZES, MAX_FRACTION, MIN_COUNT
from cdrspark.functions.sequences import kmers, masked
from cdrspark.operators.filters import with_order


def background_frequencies(sequences: DataFrame, k_sizes: Sequence[int] = KMER_SIZES) -> DataFrame:
    """k, kmer, count (occurrences), freq (their share), per_seq (share of sequences with it), n_total (sequences).

    A sequence emits each of its k-mers with whether it is the first of its kind there, so both counts come from one shuffle."""
    kept = sequences.select("cdr3_aa").filter(F.length("cdr3_aa") >= max(k_sizes))

    def one(k: int) -> DataFrame:
        places = kept.select("cdr3_aa", F.explode(F.sequence(F.lit(1), F.length("cdr3_aa") - (k - 1))).alias("at"))
        every = places.select("cdr3_aa", "at", F.substring("cdr3_aa", F.col("at"), F.lit(k)).alias("kmer"))
        first = (F.instr("cdr3_aa", F.col("kmer")) == F.col("at")).cast("long")
        return every.groupBy("kmer").agg(F.count("*").alias("count"), F.sum(first).alias("seqs")).withColumn("k", F.lit(k))

    counts = reduce(DataFrame.unionByName, [one(k) for k in k_sizes])
    # A sequence has length - k + 1 k-mers, so one row of totals needs no pass over the counts.
    total = kept.agg(F.count("*").alias("n_total"), *[F.sum(F.length("cdr3_aa") - (k - 1)).alias(f"all_{k}") for k in k_sizes])
    every = F.coalesce(*[F.when(F.col("k") == k, F.col(f"all_{k}")) for k in k_sizes])
    return counts.crossJoin(F.broadcast(total)).select(
        "k", "kmer", "count", (F.col("count") / every).alias("freq"), (F.col("seqs") / F.col("n_total")).alias("per_seq"), "n_total"
    )


def tested_sequences(contigs: DataFrame, chains: Sequence[str], k_sizes: Sequence[int]) -> DataFrame:
    """chain, row, cell_id, cdr3_aa of the contigs in which motifs are sought."""
    rows = with_order(contigs).filter(F.col("chain_type").isin(*chains) & (F.length("cdr3_aa") >= max(k_sizes)))
    return rows.select(F.col("chain_type").alias("chain"), F.col("ord").alias("row"), "cell_id", "cdr3_aa")


def motif_rows(sequences: DataFrame, k_sizes: Sequence[int] = KMER_SIZES) -> DataFrame:
    """chain, k, kmer, row, cell_id: each different k-mer of each sequence once."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.array_distinct(kmers(F.col("cdr3_aa"), k)).alias("kmers")) for k in k_sizes])
    rows = sequences.select("chain", "row", "cell_id", F.explode(each).alias("x"))
    return rows.select("chain", "x.k", "row", "cell_id", F.explode("x.kmers").alias("kmer"))


def _within_bounds(counts: DataFrame, totals: DataFrame, min_count: int, max_fraction: float) -> DataFrame:
    joined = counts.join(F.broadcast(totals), "chain")  # one row a chain type, of two
    return joined.filter((F.col("count_obs") >= min_count) & (F.col("count_obs") <= F.lit(max_fraction) * F.col("n_input")))


def totals_of(sequences: DataFrame) -> DataFrame:
    """One row a chain type: n_input."""
    return sequences.groupBy("chain").agg(F.count("*").alias("n_input"))


def candidates(rows: DataFrame, totals: DataFrame, min_count: int = MIN_COUNT, max_fraction: float = MAX_FRACTION) -> DataFrame:
    """chain, k, kmer, count_obs, n_input of k-mers that are neither rare nor common."""
    return _within_bounds(rows.groupBy("chain", "k", "kmer").agg(F.count("*").alias("count_obs")), totals, min_count, max_fraction)


def _tokens(df: DataFrame, k_sizes: Sequence[int]) -> DataFrame:
    """df with a row for each masked token of its kmer."""
    parts = [df.filter(F.col("k") == k).withColumn("token", F.explode(masked(F.col("kmer"), k))) for k in k_sizes]
    return reduce(DataFrame.unionByName, parts)


def degenerate_motifs(exact: DataFrame, k_sizes: Sequence[int] = KMER_SIZES) -> DataFrame:
    """chain, k, token: the candidates with one position widened to its residue group."""
    return _tokens(exact.select("chain", "k", "kmer"), k_sizes).select("chain", "k", "token").distinct()


def degenerate_rows(rows: DataFrame, tokens: DataFrame, k_sizes: Sequence[int] = KMER_SIZES) -> DataFrame:
    """chain, k, token, row, cell_id: sequences that hold a token.

    A token has one widened place, so a k-mer fits it exactly if one of the k-mer's own tokens equals it: an
    equi-join where a regular expression would compare every token with every sequence."""
    own = _tokens(rows, k_sizes).drop("kmer")
    return own.join(tokens, ["chain", "k", "token"], "left_semi").dropDuplicates(["chain", "k", "token", "row"])


def degenerate_candidates(held: DataFrame, totals: DataFrame, min_count: int = MIN_COUNT, max_fraction: float = MAX_FRACTION) -> DataFrame:
    return _within_bounds(held.groupBy("chain", "k", "token").agg(F.count("*").alias("count_obs")), totals, min_count, max_fraction)


def degenerate_background(background: DataFrame, tokens: DataFrame, k_sizes: Sequence[int] = KMER_SIZES) -> DataFrame:
    """k, token, bg: the sum of per_seq over the background k-mers that fit."""
    fits = _tokens(background.select("k", "kmer", "per_seq"), k_sizes)
    return fits.join(tokens.select("k", "token").distinct(), ["k", "token"], "left_semi").groupBy("k", "token").agg(F.sum("per_seq").alias("bg"))
