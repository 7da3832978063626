"""Oracle SQL of the catalogue's queries, built from shared common table expressions."""

from __future__ import annotations

from cdrspark.functions.constants import AMINO_ACIDS, FREE_PAIRS, GROUPS, HALF_PAIRS
from cdrspark.plans.catalogue import CHAIN_TEXTS, CONTIG_COLUMNS, NAMES
from cdrspark.plans.fixtures import oracle_ctes


def _query(body: str, *views: str) -> str:
    return "with recursive " + ",\n".join([oracle_ctes(), *views]) + "\n" + body


def _both_ways(pairs: str) -> str:
    return " " + " ".join(f"{p} {p[::-1]}" for p in pairs.split()) + " "


def _cost(x: str, y: str) -> str:
    token = f"concat(' ', {x}, {y}, ' ')"
    return f"case when {x} = {y} then 0e0 when instr('{_both_ways(FREE_PAIRS)}', {token}) > 0 then 0e0 when instr('{_both_ways(HALF_PAIRS)}', {token}) > 0 then 0.5e0 else 1e0 end"


def _equal(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: {_cost(f'substr({a}, cast(i as int), 1)', f'substr({b}, cast(i as int), 1)')}))"


def _gapped(short: str, long: str) -> str:
    inner = _cost(f"substr({short}, cast(i as int), 1)", f"substr({long}, cast(case when i < g then i else i + 1 end as int), 1)")
    return f"list_min(list_transform(range(1, length({long}) + 1), lambda g: 0.5e0 + list_sum(list_transform(range(1, length({short}) + 1), lambda i: {inner}))))"


def _weighted(a: str, b: str) -> str:
    return f"case when length({a}) = length({b}) then {_equal(a, b)} when length({a}) = length({b}) - 1 then {_gapped(a, b)} when length({b}) = length({a}) - 1 then {_gapped(b, a)} else cast('inf' as double) end"


def _seqs(chain: str) -> str:
    return f"q as (select cdr3_aa as seq, arg_min(cell_id, ord) as id, min(ord) as ord from f where chain_type = '{chain}' and length(cdr3_aa) >= 5 group by cdr3_aa)"


def _edges(condition: str, distance: str, most: str, chain: str = "heavy") -> str:
    return f"""e as (
  select a.id as seq_id_1, b.id as seq_id_2, a.seq as cdr3_1, b.seq as cdr3_2, {distance} as distance, '{chain}' as chain
  from q a join q b on a.ord < b.ord and {condition}
  where {distance} {most})"""


HAMMING = (_seqs("heavy"), _edges("length(a.seq) = length(b.seq)", "cast(hamming(a.seq, b.seq) as double)", "between 1 and 2"))
EDGE_COLUMNS = "seq_id_1, seq_id_2, cdr3_1, cdr3_2, round(distance, 6) as distance, chain"


def _components(pairs: str) -> tuple[str, ...]:
    """Views l (links both ways) and lab (cell_id, comp: its smallest reachable cell)."""
    return (
        f"l as (select u, v from ({pairs}) union select v, u from ({pairs}))",
        "reach as (select u, u as r from l union select reach.u, l.v from reach join l on reach.r = l.u)",
        "lab as (select u as cell_id, min(r) as comp from reach group by u)",
    )


LARGE = "m as (select cell_id, concat('cluster_', comp) as cluster_id from lab where comp in (select comp from lab group by comp having count(*) >= 3))"
MEMBERSHIP = (*HAMMING, *_components("select seq_id_1 as u, seq_id_2 as v from e"), LARGE)

COLLAPSED = (
    "rep as (select * exclude (n) from (select *, row_number() over (partition by clone_id, chain_type order by ord) as n from f where clone_id is not null and clone_id <> '') where n = 1)",
    "col as (select * from rep union all select * from f where clone_id is null or clone_id = '')",
)


def _mode(column: str, name: str) -> str:
    return f"""{name} as (
  select cluster_id, {column}, n, total from (
    select cluster_id, {column}, count(*) as n, sum(count(*)) over (partition by cluster_id) as total,
           row_number() over (partition by cluster_id order by count(*) desc, {column}) as k
    from j where chain_type = 'heavy' and {column} is not null group by cluster_id, {column}) where k = 1)"""


def _log_choose(n: str, i: str) -> str:
    return f"(lgamma({n} + 1e0) - lgamma({i} + 1e0) - lgamma({n} - {i} + 1e0))"


def _binomial(x: str, n: str, p: str) -> str:
    return f"least(1e0, list_sum(list_transform(range({x}, {n} + 1), lambda i: exp({_log_choose(n, 'i')} + i * ln({p}) + ({n} - i) * ln(1e0 - {p})))))"


def _log10(p: str) -> str:
    return f"round(log10(greatest({p}, 1e-300)), 6)"


SUMMARY = (
    *COLLAPSED,
    "j as (select m.cluster_id, col.* from m left join col using (cell_id))",
    _mode("v_gene", "topv"),
    _mode("j_gene", "topj"),
    _mode("cdr3_aa", "topc"),
    "bgv as (select v_gene, count(*) as gene_bg, sum(count(*)) over () as total_bg from col where chain_type = 'heavy' and v_gene is not null group by v_gene)",
    """fish as (
  select cluster_id, topv.v_gene as gene, n as a, cast(total as bigint) as draws, greatest(gene_bg - n, 0) + n as good,
         cast(total as bigint) + greatest(gene_bg - n, 0) + greatest(cast(total_bg as bigint) - cast(total as bigint) - greatest(gene_bg - n, 0), 0) as everything,
         total >= 2 and total_bg >= 10 as ok
  from topv join bgv using (v_gene))""",
    f"""fp as (
  select cluster_id, case when ok then gene end as gene,
         case when ok then least(1e0, list_sum(list_transform(range(a, least(draws, good) + 1), lambda i:
           case when draws - i > everything - good then 0e0 else
           exp({_log_choose('good', 'i')} + {_log_choose('(everything - good)', '(draws - i)')} - {_log_choose('everything', 'draws')}) end))) else 1e0 end as p
  from fish)""",
    """agg as (
  select cluster_id, count(*) as n_members, count(*) filter (where chain_type = 'heavy') as n_heavy,
         count(*) filter (where chain_type = 'light') as n_light,
         count(distinct clone_id) filter (where chain_type = 'heavy') as n_clones,
         count(distinct sample_id) + max(case when sample_id is null then 1 else 0 end) as n_samples,
         avg(length(cdr3_aa)) filter (where chain_type = 'heavy') as mean_len,
         case when count(*) filter (where chain_type = 'heavy') > 1 then stddev_samp(length(cdr3_aa)) filter (where chain_type = 'heavy') else 0 end as sd_len
  from j group by cluster_id)""",
    "smp as (select count(distinct sample_id) + max(case when sample_id is null then 1 else 0 end) as samples from col)",
    """cl as (
  select agg.*, topc.cdr3_aa as cdr3h_consensus, topv.v_gene as top_vh, topj.j_gene as top_jh, fp.gene as vh_enriched_gene,
         coalesce(fp.p, 1e0) as p, n_clones / greatest(n_members, 1) as clonal_diversity, n_samples / samples as sample_diversity
  from agg left join topc using (cluster_id) left join topv using (cluster_id) left join topj using (cluster_id) left join fp using (cluster_id), smp)""",
    """sc as (
  select *, round(0.2e0 * log2(n_members + 1) / 10 + 0.25e0 * clonal_diversity + 0.25e0 * sample_diversity
         + 0.15e0 * least(-log10(p + 1e-300) / 50, 1e0) + 0.15e0 * greatest(1 - sd_len / 5, 0e0), 4) as score
  from cl)""",
)
CLUSTERS = (*MEMBERSHIP, *SUMMARY)
CLUSTER_COLUMNS = """cluster_id, n_members, n_heavy, n_light, n_clones, n_samples, cdr3h_consensus, round(mean_len, 9) as cdr3h_len_mean, round(sd_len, 9) as cdr3h_len_sd, top_vh, top_jh,
       vh_enriched_gene, round(clonal_diversity, 9) as clonal_diversity, round(sample_diversity, 9) as sample_diversity"""


def _kmer_list(seq: str, k: str) -> str:
    return f"list_transform(range(1, length({seq}) - {k} + 2), lambda i: substr({seq}, cast(i as int), {k}))"


def _background(ks: tuple[int, ...] = (4, 5), table: str = "bg") -> tuple[str, ...]:
    each = " union all ".join(f"select {k} as k, seq_id, unnest({_kmer_list('cdr3_aa', str(k))}) as kmer from {table} where length(cdr3_aa) >= 5" for k in ks)
    return (
        f"bk as ({each})",
        f"bt as (select count(*) as n_total from {table} where length(cdr3_aa) >= 5)",
        """bf as (
  select k, kmer, count(*) as count, count(*) / sum(count(*)) over (partition by k) as freq,
         count(distinct seq_id) / (select n_total from bt) as per_seq, (select n_total from bt) as n_total
  from bk group by k, kmer)""",
    )


def _candidates(chains: str, ks: tuple[int, ...], least_length: int) -> tuple[str, ...]:
    each = " union all ".join(f"select chain_type as chain, {k} as k, ord, cell_id, unnest(list_distinct({_kmer_list('cdr3_aa', str(k))})) as kmer from s" for k in ks)
    return (
        f"s as (select * from f where chain_type in ({chains}) and length(cdr3_aa) >= {least_length})",
        "tot as (select chain_type as chain, count(*) as n_input from s group by 1)",
        f"km as ({each})",
        "cand as (select chain, k, kmer, count(*) as count_obs, any_value(n_input) as n_input from km join tot using (chain) group by chain, k, kmer having count(*) >= 3 and count(*) <= 0.2e0 * any_value(n_input))",
    )


def _token(c: str) -> str:
    return "case " + " ".join(f"when instr('{g}', {c}) > 0 then '{g}'" for g in GROUPS.values()) + " end"


DEGENERATE = (
    f"""tok0 as (
  select distinct chain, k, substr(kmer, 1, cast(p - 1 as int)) as pre, {_token('substr(kmer, cast(p as int), 1)')} as grp, substr(kmer, cast(p + 1 as int)) as suf, p
  from cand, unnest(range(1, k + 1)) as u(p))""",
    "tok as (select chain, k, concat(pre, '[', grp, ']', suf) as token, any_value(pre) as pre, any_value(grp) as grp, any_value(suf) as suf, any_value(p) as p from tok0 where grp is not null group by 1, 2, 3)",
    """held as (
  select distinct tok.chain, tok.k, token, ord from tok join km on km.chain = tok.chain and km.k = tok.k and starts_with(kmer, pre)
    and substr(kmer, cast(p + 1 as int)) = suf and instr(grp, substr(kmer, cast(p as int), 1)) > 0)""",
    "dc as (select chain, k, token, count(*) as count_obs, any_value(n_input) as n_input from held join tot using (chain) group by 1, 2, 3 having count(*) >= 3 and count(*) <= 0.2e0 * any_value(n_input))",
    """db as (
  select tok.k, token, sum(per_seq) as bgp from (select distinct k, token, pre, grp, suf, p from tok) tok
    join bf on bf.k = tok.k and starts_with(kmer, pre) and substr(kmer, cast(p + 1 as int)) = suf and instr(grp, substr(kmer, cast(p as int), 1)) > 0
  group by 1, 2)""",
)

EXACT_TESTS = "select 'exact' as kind, chain, cand.k, cand.kmer as motif, count_obs, n_input, coalesce(per_seq, 1e0 / (select n_total from bt)) as ref from cand left join bf on bf.k = cand.k and bf.kmer = cand.kmer"
DEGENERATE_TESTS = "select 'degenerate' as kind, chain, dc.k, dc.token as motif, count_obs, n_input, least(case when bgp > 0 then bgp else 1e0 / (select n_total from bt) end, 0.99e0) as ref from dc left join db on db.k = dc.k and db.token = dc.token"
TESTED = f"*, count_obs / n_input as freq_obs, (count_obs / n_input) / greatest(ref, 1e-10) as fold, {_binomial('count_obs', 'n_input', 'greatest(ref, 1e-10)')} as pv"
ADJUSTED = """adj as (
  select *, least(1e0, min(pv * m / rn) over (order by pv, kind, chain, k, motif rows between current row and unbounded following)) as pa from (
    select *, row_number() over (order by pv, kind, chain, k, motif) as rn, count(*) over () as m from t))"""
SHOWN = f"motif, k, chain, count_obs, round(freq_obs, 9) as freq_obs, round(ref, 9) as freq_ref, round(fold, 6) as fold_enrichment, {_log10('pv')} as log_p"


def _tests(chains: str, ks: tuple[int, ...], least_length: int, parts: str, *more: str) -> tuple[str, ...]:
    return (*_background(), *_candidates(chains, ks, least_length), *more, f"t as (select {TESTED} from ({parts}))", ADJUSTED)


HEAVY4 = _tests("'heavy'", (4,), 5, EXACT_TESTS)
HEAVY_BOTH_K = _tests("'heavy'", (4, 5), 5, EXACT_TESTS)
SIGNIFICANT = "pa < 0.05e0 and fold >= 10"


def _members(k: int) -> tuple[str, ...]:
    """kept motifs of one k tested alone, and their members."""
    return (*_tests("'heavy'", (k,), k, EXACT_TESTS), f"kept as (select * from adj where {SIGNIFICANT})", "mem as (select motif, pa, km.ord, cell_id from kept join km on km.kmer = kept.motif)")


KNOWN = """kn as (
  select trim(part) as cdr3h, cdr3l, antigen, organism, source, pdb_id,
         regexp_replace(regexp_replace(upper(trim(part)), '^C', ''), '[WF]$', '') as cdr3h_canon
  from (select *, unnest(string_split(cdr3h, ';')) as part from known) where length(trim(part)) > 0)"""
MATCHED = (
    KNOWN,
    "cs as (select distinct cluster_id, cdr3_aa as query_cdr3, regexp_replace(regexp_replace(upper(trim(cdr3_aa)), '^C', ''), '[WF]$', '') as canon from m join f using (cell_id) where chain_type = 'heavy')",
    "ex as (select cluster_id, query_cdr3, cdr3h as match_cdr3, 'exact' as match_type, 0e0 as distance, antigen, organism, source, pdb_id from cs join kn on canon = cdr3h_canon)",
    f"""nr as (
  select cluster_id, query_cdr3, cdr3h as match_cdr3, 'near' as match_type, {_weighted('canon', 'cdr3h_canon')} as distance, antigen, organism, source, pdb_id
  from cs join kn on abs(length(canon) - length(cdr3h_canon)) <= 1
  where canon not in (select cdr3h_canon from kn))""",
)
ANNOTATED = (*MEMBERSHIP, *MATCHED)


def _adjust(value: str) -> str:
    return f"""
with p as (select s_suppkey, (s_suppkey * 37 % 101 + 1) / 2048e0 as p from supplier),
r as (select *, row_number() over (order by p, s_suppkey) as rn, count(*) over () as m from p)
select s_suppkey, round({value}, 9) as adj from r"""


BEHIND = "over (order by p, s_suppkey rows between current row and unbounded following)"
BEFORE = "over (order by p, s_suppkey rows between unbounded preceding and current row)"

PARTS = "list_filter(string_split(text, '.'), lambda t: {})[-1]"
V_RULE, D_RULE, J_RULE = ("regexp_matches(t, '^IG[HKL]V')", "regexp_matches(t, '^IGHD')", "regexp_matches(t, '^IG[HKL]J')")

#: The whole pipeline: contigs, enriched motifs of one length, weighted edges, clusters of stars and edges.
WHOLE = (
    *_members(5),
    _seqs("heavy"), _edges("abs(length(a.seq) - length(b.seq)) <= 1", _weighted("a.seq", "b.seq"), "<= 0.5"),
    *_components("select seq_id_1 as u, seq_id_2 as v from e union all select a.cell_id, b.cell_id from mem a join mem b on a.motif = b.motif and a.ord < b.ord"),
    LARGE,
)


def _cliques() -> str:
    """Cells and the smallest cell of their forty."""
    name = "concat('n', lpad(cast({} as varchar), 12, '0'))"
    return f"select {name.format('p_partkey')} as cell_id, {name.format('min(p_partkey) over (partition by p_partkey // 40)')} as community from part"


def _loaded(cell: str, sample: str, productive: str, clone: str, where: str = "true") -> str:
    return f"select {cell} as cell_id, '{sample}' as sample_id, chain, chain_type, v_gene, j_gene, cdr3_aa, {clone} as clone_id from x where {productive} and {where}"


#: The contigs with the flags that the readers look at.
SPELT = """x as (
  select *, ord // 2 as k, (ord // 2) % 13 <> 0 as is_cell, (ord // 2) % 17 <> 0 and (ord // 2) % 19 <> 0 as ok, row_number() over (order by ord) as n from bcr)"""
CLEAN = "regexp_matches(cdr3_aa, '^[ACDEFGHIKLMNPQRSTVWY]+$')"
DIRTY = "ub as (select seq_id, case when seq_id % 29 = 0 then concat(cdr3_aa, 'X') else cdr3_aa end as cdr3_aa from bg)"

ORACLE_SQL: dict[str, str] = {
    "bcr_filter": _query(f"select {', '.join(CONTIG_COLUMNS)} from f"),
    "standardise_chain": f"""
with t as (select * from ({NAMES}) as t(name)),
c as (select name, case when upper(name) in ('IGH', 'HEAVY') then 'IGH' when upper(name) in ('IGK', 'KAPPA') then 'IGK' when upper(name) in ('IGL', 'LAMBDA') then 'IGL' else upper(name) end as chain from t)
select name, chain, case when chain is null then null when chain = 'IGH' then 'heavy' else 'light' end as chain_type from c""",
    "canon_cdr3": _query("select cell_id, chain, regexp_replace(regexp_replace(upper(trim(cdr3_aa)), '^C', ''), '[WF]$', '') as canon from bcr"),
    "chain_parse": f"""
select text, {PARTS.format(V_RULE)} as v_gene, {PARTS.format(f'not {V_RULE} and {D_RULE}')} as d_gene, {PARTS.format(f'not {V_RULE} and not {D_RULE} and {J_RULE}')} as j_gene,
  {PARTS.format(f"not {V_RULE} and not {D_RULE} and not {J_RULE} and regexp_matches(t, '^C[A-Z]') and length(t) > 5")} as cdr3_aa
from ({CHAIN_TEXTS}) as x(text)""",
    "primary_chain": _query("""
select cell_id, chain_type, chain, cdr3_aa, ord from (
  select *, row_number() over (partition by cell_id, chain_type order by ord) as n from (
    select * exclude (cell_id), concat('c', cast((ord // 2) % 97 as varchar)) as cell_id from bcr)) where n = 1"""),
    "collapse_clones": _query(f"select {', '.join(CONTIG_COLUMNS)} from col", *COLLAPSED),
    "validate_counts": _query("select count(*) as n_rows, count(*) filter (where chain_type = 'heavy') as n_heavy, count(*) filter (where chain_type = 'light') as n_light from bcr"),
    "motif_candidates": _query("select chain, k, kmer, count_obs, n_input from cand", *_candidates("'heavy', 'light'", (4, 5), 5)),
    "motif_enrichment": _query(f"select {SHOWN} from t where k = 4", *HEAVY4),
    "motif_bh": _query(f"select {SHOWN}, {_log10('pa')} as log_p_adj from adj where {SIGNIFICANT}", *HEAVY4),
    "motif_members": _query("select motif, count(*) as n, string_agg(cell_id, ';' order by ord) as member_ids from mem group by motif", *_members(4)),
    "degenerate_motifs": _query("select chain, k, token from tok", *_candidates("'heavy'", (4, 5), 5), *DEGENERATE[:2]),
    "degenerate_enrichment": _query(f"select {SHOWN} from t", *_tests("'heavy'", (4,), 4, DEGENERATE_TESTS, *DEGENERATE)),
    "enriched_motifs": _query(f"select kind, {SHOWN}, {_log10('pa')} as log_p_adj from adj where {SIGNIFICANT}", *_tests("'heavy', 'light'", (4, 5), 5, f"{EXACT_TESTS} union all {DEGENERATE_TESTS}", *DEGENERATE)),
    "global_hamming": _query(f"select {EDGE_COLUMNS} from e", *HAMMING),
    "global_weighted": _query(f"select {EDGE_COLUMNS} from e", _seqs("heavy"), _edges("length(a.seq) = length(b.seq)", _equal("a.seq", "b.seq"), "<= 2")),
    "global_gapped": _query(f"select {EDGE_COLUMNS} from e", _seqs("heavy"), _edges("abs(length(a.seq) - length(b.seq)) = 1", _weighted("a.seq", "b.seq"), "<= 2")),
    "global_multiplicity": _query(
        f"select {EDGE_COLUMNS} from e join (select distinct length(seq) as w from q) on w between greatest(length(cdr3_1), length(cdr3_2)) - 1 and least(length(cdr3_1), length(cdr3_2))",
        _seqs("light"), _edges("abs(length(a.seq) - length(b.seq)) <= 1", _weighted("a.seq", "b.seq"), "<= 1", "light"),
    ),
    "global_paired": _query(
        "select seq_id_1, seq_id_2, cdr3_1, cdr3_2, round(distance, 6) as distance, 'paired' as chain from d where distance <= 1",
        "pr as (select h.cell_id as id, h.ord, h.cdr3_aa as h, l.cdr3_aa as l from f h join f l on h.cell_id = l.cell_id and h.chain_type = 'heavy' and l.chain_type = 'light')",
        f"""d as (
  select a.id as seq_id_1, b.id as seq_id_2, concat(a.h, '|', a.l) as cdr3_1, concat(b.h, '|', b.l) as cdr3_2, 0.7e0 * ({_weighted('a.h', 'b.h')}) + 0.3e0 * ({_weighted('a.l', 'b.l')}) as distance
  from pr a join pr b on a.ord < b.ord and abs(length(a.h) - length(b.h)) <= 1 and abs(length(a.l) - length(b.l)) <= 1)""",
    ),
    "edge_combine": _query(
        """
select cell_1, cell_2, round(-minus, 6) as weight, case when type = 0 then 'local_motif' else 'global_similarity' end as edge_type from (
  select cell_1, cell_2, minus, type, row_number() over (partition by cell_1, cell_2 order by minus, type) as n from u) where n = 1""",
        *_members(5), *HAMMING,
        """u as (
  select least(a.cell_id, b.cell_id) as cell_1, greatest(a.cell_id, b.cell_id) as cell_2, -1e0 as minus, 0 as type from mem a join mem b on a.motif = b.motif and a.ord < b.ord
  union all select least(seq_id_1, seq_id_2), greatest(seq_id_1, seq_id_2), -1e0 / (1e0 + distance), 1 from e)""",
    ),
    "components": _query("select cell_id, comp from lab", *HAMMING, *_components("select seq_id_1 as u, seq_id_2 as v from e")),
    "star_components": _query("select cell_id, comp from lab", *_members(5), *_components("select a.cell_id as u, b.cell_id as v from mem a join mem b on a.motif = b.motif and a.ord < b.ord")),
    "cluster_size_filter": _query("select cell_id, cluster_id from m", *MEMBERSHIP),
    "network_vertices": _query("select lab.cell_id, m.cluster_id as cluster from lab left join m using (cell_id)", *MEMBERSHIP),
    "cluster_sequences": _query("select distinct cluster_id, cdr3_aa as query_cdr3 from m join f using (cell_id) where chain_type = 'heavy'", *MEMBERSHIP),
    "vgene_fisher": _query(f"select cluster_id, {_log10('p')} as log_p, gene as vh_enriched_gene from fp", *CLUSTERS),
    "cluster_summary": _query(
        f"select {CLUSTER_COLUMNS} from cl",
        *CLUSTERS,
    ),
    "cluster_score": _query("select cluster_id, score from sc", *CLUSTERS),
    "known_specificity": _query("select * from kn where length(cdr3h_canon) > 0", KNOWN),
    "annotate_exact": _query("select * from ex", *ANNOTATED),
    "annotate_near": _query("select * replace (round(distance, 6) as distance) from nr where distance <= 1", *ANNOTATED),
    "plot_vgene_usage": _query("select top_vh, count(*) as n from cl where top_vh is not null group by top_vh order by n desc, top_vh limit 15", *CLUSTERS),
    "plot_motif_bars": _query(f"select motif, chain, round(-log10(pa + 1e-300), 6) as neg_log_p from adj where {SIGNIFICANT} order by pa, chain, k, motif limit 20", *HEAVY4),
    "plot_size_hist": _query(
        """
select bin, round(lo + (bin - 1) * width, 9) as lo, round(lo + (bin - 1) * width + width, 9) as hi, (select count(*) from cl where least(cast(floor((n_members - lo) / width) as int) + 1, 30) = bin) as n
from (select min(n_members) as lo, case when max(n_members) > min(n_members) then (max(n_members) - min(n_members)) / 30 else 1e0 end as width from cl), (select unnest(range(1, 31)) as bin)""",
        *CLUSTERS,
    ),
    "plot_samples": _query("select n_samples, count(*) as n from cl group by n_samples", *CLUSTERS),
    "plot_size_diversity": _query("select cluster_id, n_members, round(clonal_diversity, 9) as clonal_diversity from cl", *CLUSTERS),
    "summary_stats": _query(
        """
select count(*) as n_clusters, min(n_members) as min_size, max(n_members) as max_size, cast(floor(median(n_members)) as bigint) as median_size,
       count(*) filter (where n_samples > 1) as n_multi_sample, (select count(*) from m) as n_cells, cast(0 as bigint) as n_annotated from cl""",
        *CLUSTERS,
    ),
    "top_clusters": _query("select cluster_id, n_members, n_clones, n_samples, cdr3h_consensus, top_vh, score from sc order by sc.score desc, cluster_id limit 20", *CLUSTERS),
    "adjust_none": _adjust("p"),
    "adjust_bonferroni": _adjust("least(1e0, p * m)"),
    "adjust_holm": _adjust(f"least(1e0, max(p * (m - rn + 1)) {BEFORE})"),
    "adjust_hochberg": _adjust(f"least(1e0, min(p * (m - rn + 1)) {BEHIND})"),
    "adjust_bh": _adjust(f"least(1e0, min(p * m / rn) {BEHIND})"),
    "adjust_by": _adjust(f"least(1e0, min(list_sum(list_transform(range(1, m + 1), lambda i: 1e0 / i)) * p * m / rn) {BEHIND})"),
    "adjust_hommel": _adjust("(select max(least(b, j * r.p)) from (select j, min(j * r2.p / (r2.rn - (m - j))) as b from (select unnest(range(1, (select count(*) from p) + 1)) as j), r r2 where r2.rn > r2.m - j group by j))"),
    "full_pipeline": _query(f"select {CLUSTER_COLUMNS}, {_log10('p')} as log_p, score from sc", *WHOLE, *SUMMARY),
    "full_pipeline_membership": _query("select cell_id, cluster_id from m", *WHOLE),
    "full_pipeline_motifs": _query(
        f"select {SHOWN}, {_log10('pa')} as log_p_adj, (select string_agg(cell_id, ';' order by mem.ord) from mem where mem.motif = kept.motif) as member_ids, row_number() over (order by pa, kind, chain, k, motif) as ord from kept",
        *_members(5),
    ),
    "full_pipeline_annotations": _query("select * replace (round(distance, 6) as distance) from (select * from ex union all select * from nr where distance <= 1)", *WHOLE, *MATCHED),
    "cluster_order": _query("select cluster_id, row_number() over (order by score desc, cluster_id) as ord, score from sc", *CLUSTERS),
    "cluster_rescored": _query(
        """
select cluster_id, row_number() over (order by again desc, cluster_id) as ord, again as score from (
  select cluster_id, round(0.2e0 * log2(n_members + 1) / 10 + 0.25e0 * clonal_diversity + 0.25e0 * 0.5e0 + 0.15e0 * least(-log10(p + 1e-300) / 50, 1e0) + 0.15e0 * greatest(1 - sd_len / 5, 0e0), 4) as again from cl)""",
        *CLUSTERS,
    ),
    "cluster_composite": _query("select cluster_id, n_members, n_heavy, n_light, n_clones, score from sc", *CLUSTERS),
    "cluster_composite_empty": _query(
        """select cluster_id, n_members, n_heavy, n_light, n_clones, n_samples, cdr3h_consensus, mean_len as cdr3h_len_mean, sd_len as cdr3h_len_sd, top_vh, top_jh, p as vh_enrichment_p,
       vh_enriched_gene, clonal_diversity, sample_diversity, score from sc where false""",
        *CLUSTERS,
    ),
    "edge_motifs": _query(
        """
select seq_id_1, seq_id_2, round(-minus, 6) as weight, case when type = 0 then 'local_motif' else 'global_similarity' end as edge_type, motif from (
  select *, row_number() over (partition by least(seq_id_1, seq_id_2), greatest(seq_id_1, seq_id_2) order by minus, type, pa, motif, ord_1, ord_2, seq_id_1, seq_id_2) as n from u) where n = 1""",
        *_members(5), *HAMMING,
        """u as (
  select a.cell_id as seq_id_1, b.cell_id as seq_id_2, -1e0 as minus, 0 as type, a.pa, a.motif, a.ord as ord_1, b.ord as ord_2 from mem a join mem b on a.motif = b.motif and a.ord < b.ord
  union all select seq_id_1, seq_id_2, -1e0 / (1e0 + distance), 1, null, null, null, null from e)""",
    ),
    "louvain_cliques": _cliques(),
    "louvain_modularity": _query("select count(*) as n_cells, cast(1 as bigint) as components_each, true as no_worse from lab", *HAMMING, *_components("select seq_id_1 as u, seq_id_2 as v from e")),
    "network_annotated": _query("select lab.cell_id, coalesce(m.cluster_id, 'unassigned') as cluster, coalesce(m.cluster_id in (select cluster_id from ex), false) as annotated from lab left join m using (cell_id)", *ANNOTATED),
    "network_drawn": _query("select 'global_similarity' as type, count(*) as n from e union all select 'labels', count(distinct cluster_id) from m", *MEMBERSHIP),
    "plot_score_hist": _query(
        """
select bin, round(lo + (bin - 1) * width, 9) as lo, round(lo + (bin - 1) * width + width, 9) as hi, (select count(*) from sc where least(cast(floor((score - lo) / width) as int) + 1, 30) = bin) as n
from (select min(score) as lo, case when max(score) > min(score) then (max(score) - min(score)) / 30 else 1e0 end as width from sc), (select unnest(range(1, 31)) as bin)""",
        *CLUSTERS,
    ),
    "chain_names": _query("""
select cell_id, ord, name, case when name in ('trIGH', 'trIGK', 'trIGL') then upper(name) else chain end as chain, case when name like 'tr%' then 'light' else chain_type end as chain_type from (
  select *, case ord % 4 when 0 then lower(chain) when 1 then case chain when 'IGH' then 'Heavy' when 'IGK' then 'Kappa' else 'lambda' end when 2 then concat('tr', chain) else chain end as name from bcr)"""),
    "sampled_edges": "select true as within, cast(0 as bigint) as n_new, cast(0 as bigint) as n_changed",
    "synthetic_profile": "select cast(20000 as bigint) as n, cast(20000 as bigint) as n_shaped, cast(20 as bigint) as v_genes, cast(6 as bigint) as j_genes, 8 as shortest, 25 as longest, 15e0 as mean_length",
    "cost_matrix": f"""
with aa as (select unnest(string_split('{" ".join(AMINO_ACIDS)}', ' ')) as c)
select x.c as a, y.c as b, {_cost('x.c', 'y.c')} as cost from aa x, aa y""",
    "missing_columns": "select unnest(['cell_id', 'sample_id', 'chain_type', 'v_gene', 'j_gene', 'cdr3_aa', 'clone_id']) as missing, concat('missing columns: ', missing) as said",
    "load_10x": _query(
        _loaded("concat('T_b', cast(k // 2 as varchar))", "T", "first", "concat('T_', coalesce(nullif(clone_id, ''), 'NA'))"),
        SPELT.replace("x as (", "x0 as (", 1),
        "x as (select *, row_number() over (partition by k // 2, chain_type order by ord) = 1 as first from x0 where is_cell and ok)",
    ),
    "load_airr": _query(_loaded("concat('A_', cell_id)", "A", "ok", "concat('A_', coalesce(clone_id, 'NA'))"), SPELT),
    "load_combined": _query(
        """
select x.cell_id, case when k % 2 = 0 then 'X' else 'Y' end as sample_id, chain, chain_type, case when v_gene <> 'None' then v_gene end as v_gene, j_gene, cdr3_aa, h.clone_id, case when chain = 'IGH' then 'IGHD1-1' end as d_gene
from (select * replace (case when chain_type = 'light' and not starts_with(coalesce(v_gene, ''), 'IGK') then 'IGL' else chain end as chain) from x) x
join (select cell_id, clone_id from bcr where chain_type = 'heavy') h using (cell_id)
where (chain_type = 'heavy' or k % 2 = 0) and length(cdr3_aa) > 5""",
        SPELT,
    ),
    "load_units": _query(f"select cdr3_aa, concat('IGHV', cast(seq_id % 5 as varchar)) as v_gene, 'IGHJ4' as j_gene, 'IGH' as chain from ub where {CLEAN}", DIRTY),
    "sampled_units": "select cast(500 as bigint) as n, cast(0 as bigint) as n_odd",
    "load_epitopes": _query(
        """
select concat('PEP', cast(n as varchar)) as epitope_seq, antigen, organism, cdr3h, cast(null as varchar) as cdr3l, 'binding' as assay, pdb_id
from (select *, row_number() over (order by pdb_id) as n from known) where n % 3 <> 0 and organism = 'organism_a'"""
    ),
    "load_structures": _query("select pdb_id, cdr3h, cast(null as varchar) as cdr3l, antigen, cast(null as varchar) as antigen_type, cast(null as varchar) as vh, cast(null as varchar) as vl, '2.5' as resolution from known"),
    "known_union": _query("select * replace (case when source = 'IEDB' then organism end as organism) from kn where length(cdr3h_canon) > 0", KNOWN),
    "reference_round_trip": _query(
        "select k, kmer, count, round(freq, 12) as freq, round(per_seq, 12) as per_seq, n_total from bf",
        DIRTY, f"uc as (select * from ub where {CLEAN})", *_background(table="uc"),
    ),
    "export_round_trip": _query("select cluster_id, n_members, n_heavy, n_light, n_clones, n_samples, cdr3h_consensus, top_vh, top_jh, score from sc", *CLUSTERS),
    "export_membership": _query("select cell_id, cluster_id from m", *MEMBERSHIP),
} | {
    f"kmer_background_k{k}": _query(f"select k, kmer, count, round(freq, 12) as freq, round(per_seq, 12) as per_seq, n_total from bf where k = {k}", *_background())
    for k in (4, 5)
}
