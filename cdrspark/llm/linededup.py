"""Cross-site boilerplate removal by the distinct-site spread of lines.

A line's spread is the number of distinct sites (sources) it occurs on. One HyperLogLog sketch for each line
hash, merged by aggregation, finds lines far above or below the threshold; only lines near it
are counted exactly, so the decision is that of exact counts. A line at or above the threshold goes from every
document but the first that holds it, so its content stays in the corpus once.

Defined results: lines are what line feeds separate; they compare without spaces at their ends; blank lines are
never counted or removed; the null source is a site of its own; the first document is the one with the
smallest doc_id (null last), then the smallest hash of id and text, and in it the first occurrence stays;
rows with equal id and text get the same decision; a null text stays null with 0 lines; other columns pass through
unchanged, except that n_lines and n_removed replace columns of these names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdrspark.llm.common import from_texts, spread_join, written

#: Lines that are sent to every executor at most (about 80 bytes each); beyond, lines and documents are joined by shuffles.
SENT_LINES = 100_000


def _key() -> Column:
    """16 bytes that stand for a document's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.col("text"), F.lit("")))))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: h, site, doc_id, dk, pos."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    each = docs.select(F.col("doc_id"), site.alias("site"), _key().alias("dk"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    return each.select(F.unhex(F.md5("line")).alias("h"), "site", "doc_id", "dk", "pos")


def boilerplate(docs: DataFrame, min_sites: int = 10, near: float = 0.2, lg_k: int = 12) -> DataFrame:
    """The lines that are on min_sites sites or more: h, dk and pos of the occurrence that stays, and n, the occurrences.

    A sketch of 2**12 registers errs by 1.6 % (one standard deviation), so `near` is 12 of them.
    """
    lines = _lines(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "dk", "pos")).alias("first")
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), first, F.count("*").alias("n"))
    spread = written(spread.filter(F.col("sites") >= min_sites * (1 - near)), "line-spread")
    sure = spread.filter(F.col("sites") > min_sites * (1 + near))
    close = spread.filter(F.col("sites") <= min_sites * (1 + near))
    # Exact counts from distinct (line, site) pairs: however frequent the line, a task sees each pair once from every other task.
    pairs = spread_join(lines.select("h", "site"), close.select("h", "n"), "h", "n", close.agg(F.sum("n")).first()[0] or 0).distinct()
    exact = pairs.groupBy("h").agg(F.count("*").alias("exact")).filter(F.col("exact") >= min_sites)
    kept = sure.unionByName(close.join(exact.select("h"), "h", "left_semi"))
    return written(kept.select("h", F.col("first.dk").alias("dk"), F.col("first.pos").alias("pos"), "n"), "boilerplate")


def drop_lines(docs: DataFrame, lines: DataFrame, sent_lines: int = SENT_LINES) -> DataFrame:
    """docs without those lines, with n_lines (that weren't blank) and n_removed."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")])
    names = docs.columns
    if lines.count() <= sent_lines:
        out = _drop_sent(docs.withColumn("line_dedup_key", _key()), lines)
    else:
        out = _drop_joined(docs.withColumn("line_dedup_key", _key()), lines)
    return out.select(*[F.col(f"`{c}`") for c in names], "n_lines", "n_removed")


def _drop_sent(docs: DataFrame, lines: DataFrame) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast({bytes(r.h): (bytes(r.dk), r.pos) for r in lines.collect()})

    def start():
        table = sent.value

        def clean(rows: list) -> dict[str, list]:
            out: dict[str, list] = {"text": [], "n_lines": [], "n_removed": []}
            for row in rows:
                text, key = row["text"], row["key"]
                total, kept, gone = 0, [], 0
                for pos, line in enumerate(text.split("\n") if text is not None else ()):
                    bare = line.strip(" ")
                    if bare:
                        total += 1
                        stays = table.get(hashlib.md5(bare.encode("utf-8")).digest())
                        if stays is not None and stays != (key, pos):
                            gone += 1
                            continue
                    kept.append(line)
                out["text"].append(None if text is None else "\n".join(kept))
                out["n_lines"].append(total)
                out["n_removed"].append(gone)
            return out

        return clean

    both = docs.withColumn("line_dedup_row", F.struct("text", F.col("line_dedup_key").alias("key"))).drop("text", "line_dedup_key")
    return from_texts(both, {"text": "string", "n_lines": "int", "n_removed": "int"}, start, column="line_dedup_row")


def _drop_joined(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The same by joins on the line hash and the document key, for any number of lines."""
    found = _lines(docs.select("doc_id", F.lit(None).cast("string").alias("source"), "text"))
    stays = lines.select("h", F.col("dk").alias("stay_dk"), F.col("pos").alias("stay_pos"), "n")
    gone = spread_join(found, stays, "h", "n", lines.agg(F.sum("n")).first()[0] or 0).filter((F.col("dk") != F.col("stay_dk")) | (F.col("pos") != F.col("stay_pos")))
    gone = gone.groupBy("dk").agg(F.collect_set("pos").alias("line_dedup_gone"))
    both = docs.join(gone, F.col("line_dedup_key") == F.col("dk"), "left").drop("dk")
    every, out = F.split("text", "\n"), F.coalesce(F.col("line_dedup_gone"), F.array().cast("array<int>"))
    left = F.filter(every, lambda _, i: ~F.array_contains(out, i))
    return both.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(every, lambda x: F.trim(x) != ""))),
        "n_removed": F.size(out),
        "text": F.when(F.col("text").isNotNull(), F.array_join(left, "\n")),
    }).drop("line_dedup_gone")


def op8_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    cleaned = drop_lines(docs, boilerplate(docs))
    return cleaned.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.sha2("text", 256).alias("clean_sha256"))


OP8_SQL = """
with d as (
  select row_number() over () as r, doc_id, source, text,
         md5(concat(coalesce(cast(doc_id as varchar), 'null'), '|', coalesce(text, ''))) as dk
  from documents),
s as (select r, doc_id, source, dk, string_split(text, chr(10)) as parts from d where text is not null),
l as (select r, doc_id, source, dk, unnest(parts) as line, unnest(range(0, len(parts))) as pos from s),
n as (select *, trim(line) as bare from l),
b as (
  select bare from n where bare <> '' group by bare
  having count(distinct coalesce('s' || source, '-')) >= 10),
f as (
  select bare, dk as stay_dk, pos as stay_pos from (
    select n.bare, n.dk, n.pos, row_number() over (partition by n.bare order by n.doc_id nulls last, n.dk, n.pos) as k
    from n join b using (bare)) where k = 1),
m as (
  select n.*, (f.bare is not null and not (n.dk = f.stay_dk and n.pos = f.stay_pos)) as gone
  from n left join f using (bare)),
c as (
  select r, cast(sum(case when bare <> '' then 1 else 0 end) as bigint) as n_lines,
         cast(sum(case when gone then 1 else 0 end) as bigint) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept
  from m group by r)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(kept) as clean_sha256
from d left join c using (r)
"""
