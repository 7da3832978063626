"""Corpus pipeline over ``documents``: language, boilerplate lines, near copies, mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads
again for the next one. All but the last return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdrspark.llm import bpe, langid, linededup, mix, orderminhash
from cdrspark.llm.common import discard, id_remainder, recorded, shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages of this thread whose working tables may still be read: their names and the tables.
_LEFT: ContextVar[tuple[tuple[str, list[str]], ...]] = ContextVar("left", default=())


def _stage(function):
    """A stage whose working tables go when the same thread calls a later one with documents that don't read them: these have
    been written since. A caller who keeps a result unwritten while later stages run on other documents uses another thread."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        order = [stage.__name__ for _, stage in STAGES]
        files = docs.inputFiles() if _LEFT.get() else []
        kept = []
        for name, paths in _LEFT.get():
            if order.index(name) < order.index(function.__name__) and not any(path in file for file in files for path in paths):
                discard(spark, paths)
            else:
                kept.append((name, paths))
        with recorded() as made:
            out = function(spark, docs, sf_dir)
        _LEFT.set((*kept, (function.__name__, made)))
        return out

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or no letter) or with a probability below a third go; the others' lang becomes the predicted one."""
    net = langid.train(langid.sample(docs.filter(id_remainder(F.col("doc_id"), 3) != 1)))
    known = langid.identify(docs.drop("lang_pred", "score"), net, keep=True)
    known = known.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 1 / 3))
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@_stage
def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten sources or more go from all documents but the first; a document with nothing else goes."""
    cleaned = linededup.drop_lines(docs, linededup.boilerplate(docs))
    cleaned = cleaned.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the first by doc_id."""
    return orderminhash.near_duplicates(docs.select(*COLUMNS), keep=True).filter("stays").select(*COLUMNS)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, in the order of its shard."""
    return mix.mix(docs).select(*COLUMNS)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and digests of them and of the decoded text.

    Executors that have run the other stages have less memory to spare, so fewer runs are remembered."""
    texts = docs.select("doc_id", "source", "lang", "text")
    encoded = bpe.encode_table(texts, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, remembered_runs=80_000)
    return encoded.select("doc_id", "source", "lang", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: Language identification, near copies and byte pairs can't be written as SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote besides its result goes when that is written, its result when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with recorded() as made:
            stage.__wrapped__(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, [*made, *before])
        before = [path]
    return docs
