"""Receptor tables derived from the keys of the driver's tables; the same text runs in Spark and in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cdrspark.operators.kmers import background_frequencies

#: {S} is the engine's name for strings.
CONTIGS = """
with b as (
  select p_partkey as k, p_partkey % 61 as f,
         md5(concat('fam',  cast(p_partkey % 61 as {S}))) as fm,
         md5(concat('lfam', cast(p_partkey % 23 as {S}))) as lm,
         md5(concat('cell', cast(p_partkey as {S})))      as cm
  from part),
c as (
  select k, f, 'IGH' as chain, 'heavy' as chain_type,
         concat('IGHV', cast(1 + f % 7 as {S}), '-', cast(1 + k % 3 as {S})) as v0,
         concat('IGHJ', cast(1 + f % 6 as {S})) as j_gene,
         concat('C', translate(concat(substr(fm, 1, cast(7 + f % 3 as int)), substr(cm, 1, 2)),
                '0123456789abcdef', 'ADEFGHIKLNPQRSTV'), 'W') as s0
  from b
  union all
  select k, f, case when k % 2 = 0 then 'IGK' else 'IGL' end, 'light',
         concat(case when k % 2 = 0 then 'IGKV' else 'IGLV' end, cast(1 + k % 5 as {S})),
         concat('IGKJ', cast(1 + k % 4 as {S})),
         concat('C', translate(concat(substr(lm, 1, 6), substr(cm, 3, 1)),
                '0123456789abcdef', 'ADEFGHIKLNPQRSTV'), 'F')
  from b where k % 5 <> 0)
select concat('S', cast(k % 4 as {S}), '_cell', cast(k as {S})) as cell_id,
       concat('S', cast(k % 4 as {S})) as sample_id, chain, chain_type,
       case when k % 97 = 0 then null when k % 89 = 0 then 'None' else v0 end as v_gene, j_gene,
       case when k % 83 = 0 then concat(s0, 'X') when k % 79 = 0 then 'CAW' else s0 end as cdr3_aa,
       case when k % 7 = 0 then null when k % 11 = 0 then '' else concat('clone_', cast(cast((k - k % 3) / 3 as bigint) as {S})) end as clone_id,
       k * 2 + case when chain_type = 'light' then 1 else 0 end as ord
from c
"""

BACKGROUND = """
select o_orderkey as seq_id,
       concat('C', translate(substr(md5(concat('bg', cast(o_orderkey as {S}))), 1, cast(8 + o_orderkey % 6 as int)),
              '0123456789abcdef', 'ADEFGHIKLNPQRSTV'), 'W') as cdr3_aa
from orders
"""

KNOWN = """
with b as (
  select s_suppkey as k, s_suppkey % 61 as f,
         md5(concat('fam',  cast(s_suppkey % 61 as {S}))) as fm,
         md5(concat('cell', cast(s_suppkey as {S})))      as cm
  from supplier),
c as (
  select k, translate(concat(substr(fm, 1, cast(7 + f % 3 as int)),
                case when k % 4 = 0 then concat(substr(cm, 1, 1), 'W') else substr(cm, 1, 2) end),
         '0123456789abcdef', 'ADEFGHIKLNPQRSTV') as inner_aa
  from b)
select concat(case when k % 3 = 0 then '' else 'C' end, inner_aa, 'W',
              case when k % 5 = 0 then '; CAAAAAAAAAW' else '' end) as cdr3h,
       cast(null as {S}) as cdr3l,
       concat('antigen_', cast(k % 9 as {S})) as antigen,
       case when k % 2 = 0 then 'organism_a' else null end as organism,
       case when k % 2 = 0 then 'IEDB' else 'SAbDab' end as source,
       concat('pdb', cast(k as {S})) as pdb_id
from c
"""


def _run(spark: SparkSession, sf_dir: str, text: str, table: str, parts: int | None = None) -> DataFrame:
    """parts: deal the table's rows to so many parts first, as a small file is one part and its few keys are much work."""
    query = re.sub(rf"\bfrom {table}\b", f"from {{{table}}}", text.replace("{S}", "string"))
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(query, **{table: rows.repartition(parts) if parts else rows})


def contigs(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return _run(spark, sf_dir, CONTIGS, "part", parts)


def background(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return _run(spark, sf_dir, BACKGROUND, "orders", parts)


def background_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return background_frequencies(background(spark, sf_dir))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, KNOWN, "supplier")


def oracle_ctes() -> str:
    """The views bcr, bg, known and f (filtered contigs) as common table expressions."""
    text = {name: sql.replace("{S}", "varchar").strip() for name, sql in (("bcr", CONTIGS), ("bg", BACKGROUND), ("known", KNOWN))}
    views = ",\n".join(f"{n} as ({t})" for n, t in text.items())
    kept = "length(cdr3_aa) between 5 and 35 and not regexp_matches(cdr3_aa, '[X*_]') and v_gene is not null and v_gene not in ('', 'None')"
    return f"{views},\nf as (select * from bcr where {kept})"
