"""Row filters on the contig table, and representatives of cells and clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdrspark.functions.constants import MAX_CDR3, MIN_CDR3

REQUIRED = ("cell_id", "sample_id", "chain_type", "v_gene", "j_gene", "cdr3_aa", "clone_id")


def with_order(df: DataFrame) -> DataFrame:
    """df with the column ord, by which "first" is decided; rows are numbered as read if it isn't there yet."""
    return df if "ord" in df.columns else df.withColumn("ord", F.monotonically_increasing_id())


def validate(df: DataFrame) -> dict[str, int]:
    """Counts of heavy and light contigs; ValueError without the columns that the pipeline uses, or without rows."""
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError("missing columns: " + ", ".join(missing))
    row = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col("chain_type") == c).alias(c) for c in ("heavy", "light")]).first()
    if not row["rows"]:
        raise ValueError("the contig table has no rows")
    return row.asDict()


def filter_contigs(df: DataFrame, min_cdr3_len: int = MIN_CDR3, max_cdr3_len: int = MAX_CDR3, require_vgene: bool = True, remove_ambiguous: bool = True) -> DataFrame:
    """Contigs with a CDR3 of usable length, without ambiguous residues, with a V gene."""
    keep: Column = F.length("cdr3_aa").between(min_cdr3_len, max_cdr3_len)
    if remove_ambiguous:
        keep = keep & ~F.col("cdr3_aa").rlike(r"[X*_]")
    if require_vgene:
        keep = keep & F.col("v_gene").isNotNull() & ~F.col("v_gene").isin("", "None")
    return df.filter(keep)


def primary_chains(df: DataFrame) -> DataFrame:
    """The first contig of each cell and chain type."""
    df = with_order(df)
    first = Window.partitionBy("cell_id", "chain_type").orderBy("ord")
    return df.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def collapse_clones(df: DataFrame) -> DataFrame:
    """The first contig of each clone and chain type, and all contigs without a clone."""
    df = with_order(df)
    cloned = F.col("clone_id").isNotNull() & (F.col("clone_id") != "")
    columns = [F.col(f"`{c}`") for c in df.columns]
    # min_by keeps one row a task and clone before anything moves, so a huge clone is no hot key.
    rows = df.filter(cloned).groupBy("clone_id", "chain_type").agg(F.min_by(F.struct(*columns), "ord").alias("first"))
    return rows.select("first.*").unionByName(df.filter(~cloned))
