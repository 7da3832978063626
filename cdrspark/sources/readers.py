"""Loaders of contig tables into the standard contig schema.

All of them read text as strings, take absent optional columns as null, and add ord, the row's number in the
input, by which "first contig" is decided. Paths may lie in any store that Spark reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdrspark.functions.sequences import chain_parts, chain_type, is_true, standardise_chain
from cdrspark.operators.filters import primary_chains
from cdrspark.sources.schema import CONTIGS, names

TEN_X = "filtered_contig_annotations.csv"
TEN_X_COLUMNS = ("barcode", "is_cell", "chain", "v_gene", "d_gene", "j_gene", "c_gene", "cdr3", "cdr3_nt", "raw_clonotype_id", "productive")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def numbered(df: DataFrame) -> DataFrame:
    """df with ord, the rows' consecutive numbers from 1 in reading order; only a count for each partition moves."""
    rows = df.withColumn("mono", F.monotonically_increasing_id())
    counts = rows.groupBy(F.shiftright("mono", 33).alias("ord_part")).agg(F.count("*").alias("n"))
    before = sorted((r["ord_part"], r["n"]) for r in counts.collect())
    starts = [(p, at - n) for (p, n), at in zip(before, accumulate(n for _, n in before), strict=True)]
    # One row a partition of the input.
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "ord_part long, ord_from long"))
    placed = rows.withColumn("ord_part", F.shiftright("mono", 33)).join(offsets, "ord_part")
    return placed.withColumn("ord", F.col("ord_from") + F.col("mono").bitwiseAND(F.lit(2**33 - 1)) + 1).drop("mono", "ord_part", "ord_from")


def _text(df: DataFrame, column: str) -> Column:
    """A column as text, null if it is absent."""
    return F.col(f"`{column}`").cast("string") if column in df.columns else F.lit(None).cast("string")


def _standard(df: DataFrame) -> DataFrame:
    return df.select(*names(CONTIGS), "ord")


def _has_cdr3() -> Column:
    return F.length("cdr3_aa") > 0


def _clone(df: DataFrame, column: str, sample_id: str, null_missing: bool) -> Column:
    if column not in df.columns:
        return F.lit(None).cast("string")
    raw = _text(df, column)
    # A missing clonotype becomes the text sample_NA, so all such cells are one clone, unless null_missing is set.
    return F.concat(F.lit(f"{sample_id}_"), raw if null_missing else F.coalesce(raw, F.lit("NA")))


def load_10x(spark: SparkSession, path: str, sample_id: str | None = None, remove_nonproductive: bool = True, keep_multi: bool = False, null_missing_clones: bool = False) -> DataFrame:
    """A contig annotation CSV, or the folder that holds it (or whose outs folder does)."""
    csv = path
    if _is_folder(spark, path):
        csv = f"{path.rstrip('/')}/{TEN_X}"
        if not exists(spark, csv):
            csv = f"{path.rstrip('/')}/outs/{TEN_X}"
    if not exists(spark, csv):
        raise FileNotFoundError(f"no {TEN_X} at {path}")
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(csv)
    if not set(TEN_X_COLUMNS) & set(raw.columns):
        raise ValueError("the file has none of the columns of a contig annotation table")
    if sample_id is None:
        sample_id = csv.rstrip("/").split("/")[-2] if "/" in csv else "sample"
    rows = numbered(raw)
    out = rows.select(
        F.concat(F.lit(f"{sample_id}_"), F.coalesce(_text(raw, "barcode"), F.lit("NA"))).alias("cell_id"),
        F.lit(sample_id).alias("sample_id"),
        standardise_chain(_text(raw, "chain")).alias("chain"),
        *[_text(raw, c).alias(c) for c in ("v_gene", "d_gene", "j_gene", "c_gene")],
        _text(raw, "cdr3").alias("cdr3_aa"),
        _text(raw, "cdr3_nt").alias("cdr3_nt"),
        _clone(raw, "raw_clonotype_id", sample_id, null_missing_clones).alias("clone_id"),
        (is_true(F.col("is_cell")) if "is_cell" in raw.columns else F.lit(True)).alias("is_cell"),
        (is_true(F.col("productive")) if "productive" in raw.columns else F.lit(True)).alias("productive"),
        "ord",
    ).withColumn("chain_type", chain_type(F.col("chain")))
    out = out.filter("is_cell")
    if remove_nonproductive:
        out = out.filter("productive")
    if not keep_multi:
        out = primary_chains(out)  # before contigs without CDR3 go, so a cell can lose a chain
    return _standard(out.filter(_has_cdr3()))


def load_airr(spark: SparkSession, path: str, sample_id: str = "AIRR", remove_nonproductive: bool = True, null_missing_clones: bool = False) -> DataFrame:
    """A rearrangement TSV of the community standard."""
    raw = spark.read.option("header", True).option("sep", "\t").option("nullValue", "NA").csv(path)
    rows = numbered(raw)
    cell = F.coalesce(_text(raw, "cell_id"), F.lit("NA")) if "cell_id" in raw.columns else F.col("ord").cast("string")
    out = rows.select(
        F.concat(F.lit(f"{sample_id}_"), cell).alias("cell_id"),
        F.lit(sample_id).alias("sample_id"),
        standardise_chain(_text(raw, "locus")).alias("chain"),
        _text(raw, "v_call").alias("v_gene"),
        _text(raw, "d_call").alias("d_gene"),
        _text(raw, "j_call").alias("j_gene"),
        _text(raw, "c_call").alias("c_gene"),
        _text(raw, "junction_aa").alias("cdr3_aa"),
        _text(raw, "junction").alias("cdr3_nt"),
        _clone(raw, "clone_id", sample_id, null_missing_clones).alias("clone_id"),
        F.lit(True).alias("is_cell"),
        (is_true(F.col("productive")) if "productive" in raw.columns else F.lit(True)).alias("productive"),
        "ord",
    ).withColumn("chain_type", chain_type(F.col("chain")))
    if remove_nonproductive:
        out = out.filter("productive")
    return _standard(out.filter(_has_cdr3()))


def load_combined(tables: DataFrame | Sequence[DataFrame], sample_ids: Sequence[str] | None = None) -> DataFrame:
    """Combined-contig tables: dotted chain strings in IGH and in IGLC (else IGL), one row a cell.

    Several tables get sample ids S1, S2, ... (or the given ones) in place of any they have; a single one keeps its own, else S1."""
    if isinstance(tables, DataFrame):
        whole = tables if "sample_id" in tables.columns else tables.withColumn("sample_id", F.lit("S1"))
        whole = numbered(whole)
    else:
        ids = sample_ids or [f"S{i + 1}" for i in range(len(tables))]
        parts = [numbered(t.withColumn("sample_id", F.lit(s))).withColumn("table_no", F.lit(i)) for i, (t, s) in enumerate(zip(tables, ids, strict=True))]
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        whole = numbered(whole.drop("ord").drop("table_no"))
    c = set(whole.columns)
    cell = _text(whole, "barcode" if "barcode" in c else "cell_id") if c & {"barcode", "cell_id"} else F.concat("sample_id", F.lit("_"), F.col("ord").cast("string"))
    clone = _text(whole, "CTstrict" if "CTstrict" in c else "CTgene")

    def side(column: str, heavy: bool, place: int) -> Column:
        part = chain_parts(_text(whole, column))
        v = part["v_gene"]
        return F.struct(
            F.lit(place).alias("place"), _text(whole, column).alias("text"),
            (F.lit("IGH") if heavy else F.when(v.startswith("IGK"), "IGK").otherwise("IGL")).alias("chain"), F.lit("heavy" if heavy else "light").alias("chain_type"),
            v.alias("v_gene"), (part["d_gene"] if heavy else F.lit(None).cast("string")).alias("d_gene"), part["j_gene"].alias("j_gene"), part["cdr3_aa"].alias("cdr3_aa"),
        )

    both = F.array(side("IGH", True, 0), side("IGLC" if "IGLC" in c else "IGL", False, 1))
    rows = whole.select(cell.alias("cell_id"), F.col("sample_id").cast("string"), clone.alias("clone_id"), F.col("ord").alias("row"), F.explode(both).alias("x"))
    rows = rows.filter(F.length("x.text") > 0).select("cell_id", "sample_id", "clone_id", (F.col("row") * 2 + F.col("x.place")).alias("ord"), "x.*")
    nothing = F.lit(None).cast("string")
    rows = rows.withColumns({"c_gene": nothing, "cdr3_nt": nothing, "is_cell": F.lit(True), "productive": F.lit(True)})
    return _standard(rows.filter(_has_cdr3()))
