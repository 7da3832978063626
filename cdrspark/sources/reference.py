"""The background model: sequences, epitopes and structures of known specificity, k-mer frequencies.

Inputs are files that were fetched beforehand; nothing here opens a network connection.
"""

from __future__ import annotations

import csv
import gzip
import io
import itertools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdrspark.functions.constants import KMER_SIZES
from cdrspark.operators.kmers import background_frequencies
from cdrspark.sources.readers import exists
from cdrspark.sources.schema import BACKGROUND, EPITOPES, FREQUENCIES, STRUCTURES, names

SPECIES = ("human", "mouse")
DEFAULT_SEQUENCES = 500_000
UNIT_LINES = 100_000
EPITOPE_RECORDS = 50_000

# Distributions of the synthetic background.
LENGTHS = {
    8: 0.01, 9: 0.02, 10: 0.04, 11: 0.06, 12: 0.09, 13: 0.12, 14: 0.14, 15: 0.14, 16: 0.12,
    17: 0.09, 18: 0.06, 19: 0.04, 20: 0.03, 21: 0.02, 22: 0.01, 23: 0.01, 24: 0.005, 25: 0.005,
}
RESIDUES = {
    "A": 3, "R": 4, "N": 2, "D": 3, "C": 1, "Q": 2, "E": 2, "G": 6, "H": 1, "I": 2,
    "L": 3, "K": 2, "M": 1, "F": 2, "P": 2, "S": 4, "T": 3, "W": 1, "Y": 4, "V": 3,
}
V_GENES = {
    "IGHV1-2": 3, "IGHV1-18": 2, "IGHV1-69": 5, "IGHV2-5": 1, "IGHV3-7": 3, "IGHV3-15": 2, "IGHV3-21": 3,
    "IGHV3-23": 4, "IGHV3-30": 5, "IGHV3-33": 3, "IGHV3-48": 2, "IGHV3-49": 2, "IGHV3-53": 2, "IGHV3-66": 1,
    "IGHV3-74": 2, "IGHV4-4": 3, "IGHV4-34": 4, "IGHV4-39": 3, "IGHV4-59": 4, "IGHV5-51": 2,
}
J_GENES = {"IGHJ1": 0.05, "IGHJ2": 0.08, "IGHJ3": 0.10, "IGHJ4": 0.35, "IGHJ5": 0.15, "IGHJ6": 0.27}

#: Structure table columns: the first of these names that is there counts.
STRUCTURE_NAMES = {
    "pdb_id": ("pdb", "PDB"), "cdr3h": ("CDRH3", "Hchain_cdr3"), "cdr3l": ("CDRL3", "Lchain_cdr3"),
    "antigen": ("antigen_name", "antigen"), "antigen_type": ("antigen_type",), "vh": ("Hchain_v_gene", "heavy_v"),
    "vl": ("Lchain_v_gene", "light_v"), "resolution": ("resolution",),
}


@dataclass
class Reference:
    """sequences, epitopes, structures, kmer_freq: DataFrames; and the species."""

    sequences: DataFrame
    epitopes: DataFrame
    structures: DataFrame
    kmer_freq: DataFrame
    species: str = "human"


def _drawn(u: Column, weights: dict) -> Column:
    """The value whose share of the weights holds u in [0, 1)."""
    total = float(sum(weights.values()))
    ends = list(itertools.accumulate(w / total for w in weights.values()))[:-1]
    values = F.array(*[F.lit(v) for v in weights])
    return F.element_at(values, F.lit(1) + F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= u)))


def synthetic_sequences(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n heavy sequences C...W from the fixed distributions; every draw is a hash of row, place and seed."""
    u = lambda *c: F.pmod(F.xxhash64("id", *c, F.lit(seed)), F.lit(2**40)) / F.lit(float(2**40))
    rows = spark.range(n).withColumn("length", _drawn(u(F.lit(-1)), LENGTHS))
    inner = F.transform(F.sequence(F.lit(1), F.col("length") - 2), lambda i: _drawn(u(i), RESIDUES))
    return rows.select(
        F.concat(F.lit("C"), F.array_join(inner, ""), F.lit("W")).alias("cdr3_aa"),
        _drawn(u(F.lit(-2)), V_GENES).alias("v_gene"), _drawn(u(F.lit(-3)), J_GENES).alias("j_gene"), F.lit("IGH").alias("chain"),
    )


def read_unit(spark: SparkSession, paths: str, max_lines: int | None = UNIT_LINES) -> DataFrame:
    """Sequence data units (gzipped CSV whose first line is metadata): a file is one row here and is read line by line,
    max_lines of it (None: all)."""
    wanted = {"cdr3_aa": "cdr3_aa", "v_gene": "v_call", "j_gene": "j_call"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                lines = io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(data.as_py())), encoding="utf-8", newline="")
                next(lines, None)
                rows = csv.DictReader(itertools.islice(lines, max_lines))
                while part := list(itertools.islice(rows, 5000)):
                    yield pa.RecordBatch.from_pydict({**{k: pa.array([r.get(v) or None for r in part], pa.string()) for k, v in wanted.items()}, "chain": pa.array(["IGH"] * len(part), pa.string())})

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, BACKGROUND)


def read_sequences(spark: SparkSession, paths: str, n_sequences: int | None = DEFAULT_SEQUENCES, seed: int = 1, max_lines: int | None = UNIT_LINES) -> DataFrame:
    """Units of all paths, sequences of standard residues only, n_sequences of them by hash if there are more (None: all)."""
    rows = read_unit(spark, paths, max_lines).filter(F.col("cdr3_aa").rlike("^[ACDEFGHIKLMNPQRSTVWY]+$"))
    if n_sequences is None:
        return rows
    return _least_hashes(rows, F.xxhash64("cdr3_aa", "v_gene", "j_gene", F.lit(seed)), n_sequences)


def _least_hashes(rows: DataFrame, value: Column, n: int) -> DataFrame:
    """The n rows with the smallest hashes. A pass counts rows by range of hashes, so only the range in which the n-th lies is
    sorted; all rows if there are no more than n."""
    hashed = rows.withColumn("hash", value).withColumn("range", F.shiftright("hash", 52))  # 4096 ranges
    before, last = 0, None
    for r in hashed.groupBy("range").count().orderBy("range").collect():
        if before + r["count"] > n:
            last = r["range"]
            break
        before += r["count"]
    if last is None:
        return rows
    some = hashed.filter(F.col("range") == last).orderBy("hash", "cdr3_aa").limit(n - before)
    return hashed.filter(F.col("range") < last).unionByName(some).drop("hash", "range")


def empty_epitopes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EPITOPES)


def empty_structures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STRUCTURES)


def parse_epitopes(raw: DataFrame) -> DataFrame:
    """Epitope records in the fixed schema; arrays of CDR3s joined by semicolons without nulls, null if nothing is left."""
    kinds = dict(raw.dtypes)

    def text(c: str) -> Column:
        return F.col(c).cast("string") if c in kinds else F.lit(None).cast("string")

    def many(c: str) -> Column:
        if c not in kinds:
            return F.lit(None).cast("string")
        if kinds[c].startswith("array"):
            return F.nullif(F.array_join(F.filter(F.col(c).cast("array<string>"), lambda x: x.isNotNull()), ";"), F.lit(""))
        return text(c)

    assay = F.array_join("assay_names", ";") if kinds.get("assay_names", "").startswith("array") else text("assay_names")
    return raw.select(
        text("linear_sequence").alias("epitope_seq"), text("parent_source_antigen_name").alias("antigen"), text("source_organism_name").alias("organism"),
        many("receptor_chain1_cdr3_seqs").alias("cdr3h"), many("receptor_chain2_cdr3_seqs").alias("cdr3l"), assay.alias("assay"), text("pdb_id").alias("pdb_id"),
    )


def read_epitopes(spark: SparkSession, paths: str, organism: str | None = None, max_records: int | None = EPITOPE_RECORDS) -> DataFrame:
    """Epitope JSON arrays: positive linear peptides (where those columns are there), of an organism if one is given,
    the first max_records (None: all)."""
    raw = spark.read.option("multiLine", True).json(paths)
    for column, value in (("qualitative_measure", "Positive"), ("structure_type", "Linear peptide")):
        if column in raw.columns:
            raw = raw.filter(F.col(column) == value)
    if organism is not None:
        raw = raw.filter(F.col("source_organism_name").ilike(f"%{organism}%"))
    if max_records is not None:
        raw = (raw.orderBy("structure_id") if "structure_id" in raw.columns else raw).limit(max_records)
    return parse_epitopes(raw)


def parse_structures(raw: DataFrame) -> DataFrame:
    """Structure records in the fixed schema, from any of the known column names."""
    found = {k: next((n for n in own if n in raw.columns), None) for k, own in STRUCTURE_NAMES.items()}
    return raw.select(*[(F.col(f"`{n}`").cast("string") if n else F.lit(None).cast("string")).alias(k) for k, n in found.items()])


def read_structures(spark: SparkSession, paths: str) -> DataFrame:
    return parse_structures(spark.read.option("header", True).option("sep", "\t").option("nullValue", "NA").csv(paths))


def build_reference(sequences: DataFrame, epitopes: DataFrame | None = None, structures: DataFrame | None = None, species: str = "human", k_sizes: Sequence[int] = KMER_SIZES) -> Reference:
    spark = sequences.sparkSession
    return Reference(sequences, epitopes or empty_epitopes(spark), structures or empty_structures(spark), background_frequencies(sequences, k_sizes), species)


def save_reference(reference: Reference, folder: str) -> str:
    """The reference as Parquet tables under folder/species."""
    path = f"{folder.rstrip('/')}/{reference.species}"
    for name in ("sequences", "epitopes", "structures", "kmer_freq"):
        getattr(reference, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def load_reference(spark: SparkSession, folder: str, species: str = "human") -> Reference:
    if species not in SPECIES:
        raise ValueError(f"species is one of {SPECIES}")
    path = f"{folder.rstrip('/')}/{species}"
    if not exists(spark, f"{path}/kmer_freq"):
        raise FileNotFoundError(f"no reference for {species} at {path}; build_reference() and save_reference() make one")
    tables = {"sequences": BACKGROUND, "epitopes": EPITOPES, "structures": STRUCTURES, "kmer_freq": FREQUENCIES}
    return Reference(*[spark.read.parquet(f"{path}/{n}").select(*names(ddl)) for n, ddl in tables.items()], species)


def _cached(spark: SparkSession, path: str, schema: str, make: Callable[[], DataFrame], force: bool) -> DataFrame:
    """The table at path, made there first if it is absent or force is set."""
    if force or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def cached_sequences(spark: SparkSession, cache: str, paths: str | None, species: str, n_sequences: int | None = DEFAULT_SEQUENCES, force: bool = False, max_lines: int | None = UNIT_LINES) -> DataFrame:
    """The background of a species from the cache; made there from units, or synthetic without any."""

    def make() -> DataFrame:
        return read_sequences(spark, paths, n_sequences, max_lines=max_lines) if paths else synthetic_sequences(spark, n_sequences or DEFAULT_SEQUENCES)

    return _cached(spark, f"{cache.rstrip('/')}/sequences-{species}", BACKGROUND, make, force)


def cached_epitopes(spark: SparkSession, cache: str, paths: str | None, organism: str | None = None, max_records: int | None = EPITOPE_RECORDS, force: bool = False) -> DataFrame:
    """Epitopes from the cache, one table an organism; made there from epitope JSON, or empty without any."""
    name = re.sub(r"\W+", "_", organism.lower()) if organism else "all"
    return _cached(spark, f"{cache.rstrip('/')}/epitopes-{name}", EPITOPES, lambda: read_epitopes(spark, paths, organism, max_records) if paths else empty_epitopes(spark), force)


def cached_structures(spark: SparkSession, cache: str, paths: str | None, force: bool = False) -> DataFrame:
    """Structures from the cache; made there from a structure TSV, or empty without any."""
    return _cached(spark, f"{cache.rstrip('/')}/structures", STRUCTURES, lambda: read_structures(spark, paths) if paths else empty_structures(spark), force)
