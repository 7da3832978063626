"""The whole analysis in one call."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdrspark.functions import constants as C
from cdrspark.operators import annotate as A
from cdrspark.operators import motifs as M
from cdrspark.operators.clusters import Result, cluster_cells
from cdrspark.operators.filters import filter_contigs, validate, with_order
from cdrspark.operators.graph import EDGES, combined_edges, count_motif_pairs, motif_stars
from cdrspark.operators.simjoin import global_edges
from cdrspark.operators.tables import written
from cdrspark.sources.reference import Reference

log = logging.getLogger(__name__)
#: What the local and the global step take for each choice of chain.
DISPATCH = {"heavy": ("heavy", "heavy"), "light": ("light", "light"), "both": ("both", "heavy"), "paired": ("both", "paired")}


def cluster_receptors(
    contigs: DataFrame,
    reference: Reference,
    chain: str = "heavy",
    k_sizes: Sequence[int] = C.KMER_SIZES,
    motif_min_count: int = C.MIN_COUNT,
    motif_max_fraction: float = C.MAX_FRACTION,
    motif_min_fold: float = C.MIN_FOLD,
    motif_p_cutoff: float = C.P_CUTOFF,
    degenerate: bool = True,
    p_adjust_method: str = "BH",
    global_max_dist: float = C.MAX_DISTANCE,
    global_scoring: str = "weighted",
    subsample: int | None = None,
    seed: int = 1,
    min_cluster_size: int = C.MIN_CLUSTER_SIZE,
    clustering_method: str = "components",
    collapse_clones: bool = True,
    annotate: bool = True,
    full_edges: bool = False,
    max_motif_pairs: int = 1_000_000_000,
    verbose: bool = True,
) -> Result:
    """Filter, local motifs, global similarity, clusters, scores, annotations.

    The edge table has each motif's members linked to its first one: the same components as all pairs from rows in
    proportion to the members. With full_edges, and for communities, which differ without them, it has all pairs; their
    number grows with the square of a motif's members, so it is counted before and more than max_motif_pairs are an error."""
    log.setLevel(logging.INFO if verbose else logging.WARNING)
    local, far = DISPATCH[chain]
    log.info("contigs: %s", validate(contigs))
    used = written(filter_contigs(with_order(contigs)), "contigs")
    tests, members = M.motif_tests(used, reference.kmer_freq, chain=local, k_sizes=k_sizes, min_count=motif_min_count, max_fraction=motif_max_fraction, degenerate=degenerate)
    kept = written(M.significant(tests, p_adjust_method, motif_p_cutoff, motif_min_fold), "motifs")
    members = written(M.members_of(kept, members), "members")
    similar = written(global_edges(used, global_max_dist, chain=far, scoring=global_scoring, subsample=subsample, seed=seed), "global")
    links = motif_stars(members).unionByName(similar.select("seq_id_1", "seq_id_2"))
    if full_edges or clustering_method == "louvain":
        if (pairs := count_motif_pairs(members)) > max_motif_pairs:
            raise ValueError(f"{pairs} pairs of motif members; raise max_motif_pairs, or lower motif_max_fraction, or leave full edges and communities out")
        edges = written(combined_edges(kept, members, similar), "edges")
    else:
        stars = motif_stars(members).select("seq_id_1", "seq_id_2", F.lit(1.0).alias("weight"), F.lit("local_motif").alias("edge_type"), F.lit(None).cast("string").alias("motif"))
        others = similar.select("seq_id_1", "seq_id_2", (F.lit(1.0) / (1.0 + F.col("distance"))).alias("weight"), F.lit("global_similarity").alias("edge_type"), F.lit(None).cast("string").alias("motif"))
        edges = stars.unionByName(others).to(_schema(EDGES))
    result = cluster_cells(used, M.in_order(kept), links, edges, min_cluster_size, clustering_method, collapse_clones)
    result.members = members
    if annotate:
        known = A.known_specificities(reference.epitopes, reference.structures)
        result.annotations = A.annotations(result.clusters, result.membership, known, used)
    return result


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
