"""The tables behind the plots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Graphs up to this many nodes and edges are laid out on the driver; larger ones get the hash layout.
LAID_OUT_NODES, LAID_OUT_EDGES, LABELLED = 5_000, 200_000, 30


def vgene_usage(clusters: DataFrame, top_n: int = 15) -> DataFrame:
    """Clusters by their most frequent V gene."""
    counts = clusters.filter(F.col("top_vh").isNotNull()).groupBy("top_vh").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "top_vh").limit(top_n)


def motif_bars(motifs: DataFrame, top_n: int = 20) -> DataFrame:
    """The most significant motifs with -log10 of their adjusted p."""
    top = motifs.select("motif", "chain", "k", "pvalue_adj").orderBy("pvalue_adj", "chain", "k", "motif").limit(top_n)
    return top.withColumn("neg_log_p", -F.log10(F.col("pvalue_adj") + F.lit(1e-300)))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (1 to bins), lo, hi, n: counts over equal widths from the smallest to the largest value; empty bins have 0."""
    v = F.col(column).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).filter("lo is not null")
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    ends = ends.withColumn("width", width)
    at = F.least(F.floor((v - F.col("lo")) / F.col("width")).cast("int") + 1, F.lit(bins))
    counts = df.filter(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("lo", "width", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    lo = F.col("lo") + (F.col("bin") - 1) * F.col("width")
    return grid.join(counts, "bin", "left").select("bin", lo.alias("lo"), (lo + F.col("width")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def size_against_diversity(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", "n_members", "clonal_diversity")


def sample_bars(clusters: DataFrame) -> DataFrame:
    """Clusters by their number of samples."""
    return clusters.groupBy("n_samples").agg(F.count("*").alias("n"))


def spring_layout(n: int, links: np.ndarray, seed: int = 1, rounds: int = 60) -> np.ndarray:
    """Force-directed places: repulsion between all nodes, attraction along links, cooling steps."""
    rng = np.random.default_rng(seed)
    at = rng.uniform(-1, 1, (n, 2))
    k = 1 / np.sqrt(max(n, 1))
    for step in range(rounds):
        force = np.zeros((n, 2))
        for lo in range(0, n, 512):
            gap = at[lo : lo + 512, None] - at[None]
            square = (gap**2).sum(axis=2) + 1e-9
            force[lo : lo + 512] = (gap * (k * k / square)[:, :, None]).sum(axis=1)
        if len(links):
            pull = at[links[:, 0]] - at[links[:, 1]]
            pull *= (np.sqrt((pull**2).sum(axis=1)) / k)[:, None]
            np.add.at(force, links[:, 0], -pull)
            np.add.at(force, links[:, 1], pull)
        size = np.sqrt((force**2).sum(axis=1, keepdims=True)) + 1e-9
        at += force / size * np.minimum(size, 0.1 * (1 - step / rounds))
    return at


def network_plot(spark: SparkSession, nodes: DataFrame, edges: DataFrame, annotated: DataFrame | None = None, layout=None, label_clusters: bool | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Nodes (cell_id, x, y, cluster, annotated), edges (x, y, xend, yend, type), and centroids of clusters (label, x, y)
    if wanted (by default for at most 30 clusters). layout: a function of the number of nodes and the links' numbers."""
    flagged = nodes.withColumn("cluster", F.coalesce("cluster", F.lit("unassigned")))
    if annotated is not None:
        flagged = flagged.join(annotated.select(F.col("cluster_id").alias("cluster")).distinct().withColumn("annotated", F.lit(True)), "cluster", "left")
        flagged = flagged.withColumn("annotated", F.coalesce("annotated", F.lit(False)))
    else:
        flagged = flagged.withColumn("annotated", F.lit(False))
    few = flagged.limit(LAID_OUT_NODES + 1).count() <= LAID_OUT_NODES and edges.limit(LAID_OUT_EDGES + 1).count() <= LAID_OUT_EDGES
    if layout is not None and not few:
        raise ValueError(f"a layout function is used for at most {LAID_OUT_NODES} nodes and {LAID_OUT_EDGES} edges; leave it out for the hash layout")
    if few:
        names = sorted(r["cell_id"] for r in flagged.select("cell_id").collect())
        number = {c: i for i, c in enumerate(names)}
        links = np.array([(number[r[0]], number[r[1]]) for r in edges.select("seq_id_1", "seq_id_2").collect()], np.int64).reshape(-1, 2)
        at = (layout or spring_layout)(len(names), links)
        places = spark.createDataFrame([(c, float(x), float(y)) for c, (x, y) in zip(names, at, strict=True)], "cell_id string, x double, y double")
    else:
        # Clusters on a disc by hash, their cells around them.
        spread = lambda seed, *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0 - 0.5
        places = flagged.select("cell_id", *[(spread(s, "cluster") + 0.05 * spread(s, "cell_id")).alias(n) for s, n in ((1, "x"), (2, "y"))])
    placed = flagged.join(places, "cell_id").select("cell_id", "x", "y", "cluster", "annotated")
    a, b = placed.select(F.col("cell_id").alias("seq_id_1"), "x", "y"), placed.select(F.col("cell_id").alias("seq_id_2"), F.col("x").alias("xend"), F.col("y").alias("yend"))
    drawn = edges.join(a, "seq_id_1").join(b, "seq_id_2").select("x", "y", "xend", "yend", F.col("edge_type").alias("type"))
    inside = placed.filter("cluster <> 'unassigned'")
    if label_clusters is None:
        label_clusters = inside.select("cluster").distinct().limit(LABELLED + 1).count() <= LABELLED
    return placed, drawn, inside.groupBy(F.col("cluster").alias("label")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")) if label_clusters else None
