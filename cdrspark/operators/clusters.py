"""Clusters of cells: membership, aggregates, V-gene test, score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdrspark.functions.constants import MIN_CLUSTER_SIZE
from cdrspark.functions.stats import hypergeometric_p
from cdrspark.operators.filters import collapse_clones
from cdrspark.operators.graph import clusters_of
from cdrspark.operators.tables import written

CLUSTERS = (
    "cluster_id string, n_members long, n_heavy long, n_light long, n_clones long, n_samples long, cdr3h_consensus string, "
    "cdr3h_len_mean double, cdr3h_len_sd double, top_vh string, top_jh string, vh_enrichment_p double, vh_enriched_gene string, "
    "clonal_diversity double, sample_diversity double, score double"
)


@dataclass
class Result:
    """The tables of one run; annotations once annotated, members if motifs were sought."""

    clusters: DataFrame
    membership: DataFrame
    edges: DataFrame
    motifs: DataFrame
    annotations: DataFrame | None = None
    params: dict = field(default_factory=dict)
    members: DataFrame | None = None  # of motifs: kind, chain, k, motif, row, cell_id


def membership_of(edges: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE, method: str = "components") -> DataFrame:
    """cell_id, cluster_id of clusters with enough cells; a cluster is named after its label, one of its cells."""
    cells = clusters_of(edges, method)
    large = cells.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cluster_size).select("comp")
    return cells.join(large, "comp").select("cell_id", F.concat(F.lit("cluster_"), "comp").alias("cluster_id"))


def _mode(rows: DataFrame, value: str, into: str) -> DataFrame:
    """The most frequent value of each cluster, of equally frequent ones the first in order; how often; non-null values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy("cluster_id", value).agg(F.count("*").alias("n"))
    top = counts.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(value).alias("value"))).alias("t"), F.sum("n").alias("all"))
    return top.select("cluster_id", F.col("t.value").alias(into), (-F.col("t.minus")).alias(f"{into}_n"), F.col("all").alias(f"{into}_all"))


def vgene_tests(heavy: DataFrame, background: DataFrame) -> DataFrame:
    """cluster_id, vh_enrichment_p, vh_enriched_gene: the upper hypergeometric tail of the most frequent V gene.

    background: all heavy contigs, the cluster's included. Fewer than 2 genes in the cluster or 10 in all: p 1, no gene."""
    top = _mode(heavy, "v_gene", "gene")
    known = background.filter(F.col("v_gene").isNotNull())
    counts = known.groupBy(F.col("v_gene").alias("gene")).agg(F.count("*").alias("gene_bg"))
    total = known.agg(F.count("*").alias("bg"))
    # The total is one row; V genes are free text, so whether their counts are sent is left to their size.
    rows = top.join(counts, "gene").crossJoin(F.broadcast(total))
    a, b = F.col("gene_n"), F.col("gene_all") - F.col("gene_n")
    c = F.greatest(F.col("gene_bg") - a, F.lit(0))
    d = F.greatest(F.col("bg") - a - b - c, F.lit(0))
    ok = (F.col("gene_all") >= 2) & (F.col("bg") >= 10)
    tested = rows.withColumn("p", hypergeometric_p(a, a + b, a + c, a + b + c + d))
    return tested.select("cluster_id", F.when(ok, F.col("p")).otherwise(1.0).alias("vh_enrichment_p"), F.when(ok, F.col("gene")).alias("vh_enriched_gene"))


def score(n_members: Column, clonal: Column, sample: Column, p: Column, len_sd: Column) -> Column:
    """Size, clonal and sample diversity, V-gene enrichment and even lengths, weighted; four digits."""
    vgene = F.least(-F.log10(p + F.lit(1e-300)) / 50, F.lit(1.0))
    even = F.greatest(1 - len_sd / 5, F.lit(0.0))
    return F.round(0.20 * F.log2(n_members + 1) / 10 + 0.25 * clonal + 0.25 * sample + 0.15 * vgene + 0.15 * even, 4)


def with_score(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("score", score(F.col("n_members"), F.col("clonal_diversity"), F.col("sample_diversity"), F.col("vh_enrichment_p"), F.col("cdr3h_len_sd")))


def summarise(membership: DataFrame, contigs: DataFrame) -> DataFrame:
    """The cluster table, best first. contigs: after collapsing clones, if that is wanted; cells of a cluster that
    have no contig there count as one row without attributes."""
    own = contigs.select("cell_id", "sample_id", "chain_type", "v_gene", "j_gene", "cdr3_aa", "clone_id")
    rows = membership.select("cell_id", "cluster_id").join(own, "cell_id", "left")
    is_heavy = F.col("chain_type") == "heavy"
    heavy_len = F.when(is_heavy, F.length("cdr3_aa"))
    main = rows.groupBy("cluster_id").agg(
        F.count("*").alias("n_members"),
        F.count_if(is_heavy).alias("n_heavy"),
        F.count_if(F.col("chain_type") == "light").alias("n_light"),
        F.count_distinct(F.when(is_heavy, F.col("clone_id"))).alias("n_clones"),
        (F.count_distinct("sample_id") + F.max(F.col("sample_id").isNull().cast("int"))).alias("n_samples"),
        F.avg(heavy_len).alias("cdr3h_len_mean"),
        F.stddev_samp(heavy_len).alias("sd"),
    )
    main = main.withColumn("cdr3h_len_sd", F.when(F.col("n_heavy") > 1, F.col("sd")).otherwise(0.0)).drop("sd")
    heavy = rows.filter(is_heavy)
    for value, into in (("cdr3_aa", "cdr3h_consensus"), ("v_gene", "top_vh"), ("j_gene", "top_jh")):
        main = main.join(_mode(heavy, value, into).select("cluster_id", into), "cluster_id", "left")
    main = main.join(vgene_tests(heavy, own.filter(is_heavy)), "cluster_id", "left").withColumn("vh_enrichment_p", F.coalesce("vh_enrichment_p", F.lit(1.0)))
    samples = own.agg((F.count_distinct("sample_id") + F.max(F.col("sample_id").isNull().cast("int"))).alias("samples"))
    main = main.crossJoin(F.broadcast(samples))
    main = main.withColumns({"clonal_diversity": F.col("n_clones") / F.greatest("n_members", F.lit(1)), "sample_diversity": F.col("n_samples") / F.col("samples")})
    names = [x.split()[0] for x in CLUSTERS.split(", ")]
    return with_score(main).select(*names).orderBy(F.desc("score"), "cluster_id")


def rescored(result: Result) -> Result:
    """The result with scores from the present columns, in their order."""
    return Result(with_score(result.clusters).orderBy(F.desc("score"), "cluster_id"), result.membership, result.edges, result.motifs, result.annotations, result.params, result.members)


def cluster_cells(contigs: DataFrame, motifs: DataFrame, links: DataFrame, edges: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE, method: str = "components", collapse: bool = True) -> Result:
    """Clusters of the cells that links (seq_id_1, seq_id_2) connect. edges: the full edge table, which communities need
    and results show; links may be fewer edges with the same components. No links give empty tables with their columns."""
    membership = written(membership_of(links if method == "components" else edges, min_cluster_size, method), "membership")
    used = collapse_clones(contigs) if collapse else contigs
    params = {"min_cluster_size": min_cluster_size, "method": method, "collapse": collapse}
    return Result(summarise(membership, used), membership, edges, motifs, None, params)


def overview(result: Result) -> DataFrame:
    """One row: clusters, cells, smallest, largest and median size, clusters of several samples, annotated clusters."""
    sizes = result.clusters.agg(
        F.count("*").alias("n_clusters"), F.min("n_members").alias("min_size"), F.max("n_members").alias("max_size"),
        F.percentile("n_members", 0.5).cast("long").alias("median_size"), F.count_if(F.col("n_samples") > 1).alias("n_multi_sample"),
    )
    cells = result.membership.agg(F.count("*").alias("n_cells"))
    annotated = result.annotations.agg(F.count_distinct("cluster_id").alias("n_annotated")) if result.annotations is not None else result.membership.agg(F.lit(0).cast("long").alias("n_annotated"))
    return sizes.crossJoin(cells).crossJoin(annotated)


def top_clusters(clusters: DataFrame, top_n: int = 20) -> DataFrame:
    return clusters.select("cluster_id", "n_members", "n_clones", "n_samples", "cdr3h_consensus", "top_vh", "score").orderBy(F.desc("score"), "cluster_id").limit(top_n)


def print_summary(result: Result, top_n: int = 20) -> DataFrame:
    """Totals and the best clusters on the console; the cluster table."""
    o = overview(result).first()
    if not o["n_clusters"]:
        print("No clusters found.")
        return result.clusters
    print(f"Total clusters:       {o['n_clusters']}")
    print(f"Total cells assigned: {o['n_cells']}")
    print(f"Cluster sizes:        {o['min_size']} to {o['max_size']} (median {o['median_size']})")
    print(f"Multi-sample:         {o['n_multi_sample']} clusters")
    if o["n_annotated"]:
        print(f"Annotated:            {o['n_annotated']} clusters")
    top_clusters(result.clusters, top_n).show(top_n, truncate=False)
    return result.clusters
