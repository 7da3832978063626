"""Matches between clusters' CDR3s and sequences of known specificity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdrspark.functions.constants import ANNOTATION_MAX_DISTANCE
from cdrspark.functions.sequences import canonical
from cdrspark.operators.simjoin import similar_between

KNOWN = ("cdr3h", "cdr3l", "antigen", "organism", "source", "pdb_id")


def _source(table: DataFrame, name: str, organism: bool) -> DataFrame:
    has = lambda c: F.col(c).cast("string") if c in table.columns else F.lit(None).cast("string")
    return table.select(
        has("cdr3h").alias("cdr3h"), has("cdr3l").alias("cdr3l"), has("antigen").alias("antigen"),
        (has("organism") if organism else F.lit(None).cast("string")).alias("organism"), F.lit(name).alias("source"), has("pdb_id").alias("pdb_id"),
    )


def expanded(known: DataFrame) -> DataFrame:
    """One row for each of the sequences joined by semicolons, trimmed, with cdr3h_canon; empty ones go."""
    rows = known.filter(F.length("cdr3h") > 0).withColumn("cdr3h", F.explode(F.split("cdr3h", ";"))).withColumn("cdr3h", F.trim("cdr3h"))
    rows = rows.filter(F.length("cdr3h") > 0).withColumn("cdr3h_canon", canonical(F.col("cdr3h")))
    return rows.filter(F.length("cdr3h_canon") > 0).select(*KNOWN, "cdr3h_canon")


def known_specificities(epitopes: DataFrame, structures: DataFrame) -> DataFrame:
    """Both sources as one table of heavy CDR3s with what they bind."""
    return expanded(_source(epitopes, "IEDB", True).unionByName(_source(structures, "SAbDab", False)))


def cluster_sequences(membership: DataFrame, contigs: DataFrame) -> DataFrame:
    """cluster_id, query_cdr3: the different heavy CDR3s of each cluster."""
    heavy = contigs.filter((F.col("chain_type") == "heavy") & F.col("cdr3_aa").isNotNull()).select("cell_id", F.col("cdr3_aa").alias("query_cdr3"))
    return membership.join(heavy, "cell_id").select("cluster_id", "query_cdr3").distinct()


def _queries(sequences: DataFrame) -> DataFrame:
    rows = sequences.withColumn("canon", canonical(F.col("query_cdr3")))
    return rows.filter(F.length("canon") > 0)


def exact_matches(sequences: DataFrame, known: DataFrame) -> DataFrame:
    joined = _queries(sequences).join(known, F.col("canon") == F.col("cdr3h_canon"))
    return joined.select("cluster_id", "query_cdr3", F.col("cdr3h").alias("match_cdr3"), F.lit("exact").alias("match_type"), F.lit(0.0).alias("distance"), "antigen", "organism", "source", "pdb_id")


def near_matches(sequences: DataFrame, known: DataFrame, max_dist: float = ANNOTATION_MAX_DISTANCE) -> DataFrame:
    """Matches within max_dist of sequences without an exact one: each different sequence is compared once."""
    queries = _queries(sequences).join(known.select("cdr3h_canon").distinct(), F.col("canon") == F.col("cdr3h_canon"), "left_anti")
    left = queries.select(F.col("canon").alias("l_seq")).distinct()
    right = known.select(F.col("cdr3h_canon").alias("r_seq")).distinct()
    pairs = similar_between(left, right, max_dist)
    joined = queries.join(pairs, F.col("canon") == F.col("l_seq")).join(known, F.col("r_seq") == F.col("cdr3h_canon"))
    return joined.select("cluster_id", "query_cdr3", F.col("cdr3h").alias("match_cdr3"), F.lit("near").alias("match_type"), "distance", "antigen", "organism", "source", "pdb_id")


def annotations(clusters: DataFrame, membership: DataFrame, known: DataFrame, contigs: DataFrame | None = None, max_dist: float = ANNOTATION_MAX_DISTANCE) -> DataFrame:
    """Exact and near matches of each cluster's heavy CDR3s, or without contigs of its consensus."""
    if contigs is not None:
        sequences = cluster_sequences(membership, contigs)
    else:
        sequences = clusters.filter(F.col("cdr3h_consensus").isNotNull()).select("cluster_id", F.col("cdr3h_consensus").alias("query_cdr3"))
    return exact_matches(sequences, known).unionByName(near_matches(sequences, known, max_dist))
