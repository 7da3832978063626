import gzip
import json

import pytest
from pyspark.sql import functions as F

from cdrspark.operators import annotate
from cdrspark.plans.pipeline import cluster_receptors
from cdrspark.sources import build_references, readers, reference
from cdrspark.sources.schema import CONTIGS, names
from tests.mock import contigs

TEN_X = """barcode,is_cell,chain,v_gene,j_gene,cdr3,raw_clonotype_id,productive
AAA,True,IGH,IGHV1-2,IGHJ4,,clonotype1,True
AAA,True,IGH,IGHV1-3,IGHJ4,CARDGYW,clonotype1,True
AAA,True,IGK,IGKV1-5,IGKJ1,CQQYF,clonotype1,True
BBB,False,IGH,IGHV1-2,IGHJ4,CARDGYW,clonotype2,True
CCC,True,IGH,IGHV1-2,IGHJ4,CARDGYW,,None
DDD,True,Multi,,IGHJ4,None,,True
EEE,True,heavy,IGHV3-7,IGHJ6,CARWW,,true
"""


def test_10x(spark, tmp_path):
    folder = tmp_path / "sampleA"
    (folder / "outs").mkdir(parents=True)
    (folder / "outs" / readers.TEN_X).write_text(TEN_X)
    rows = {(r["cell_id"], r["chain_type"]): r for r in readers.load_10x(spark, str(folder)).collect()}
    # AAA loses its heavy chain: the first contig was chosen before contigs without CDR3 went.
    assert set(rows) == {("outs_AAA", "light"), ("outs_DDD", "light"), ("outs_EEE", "heavy")}
    assert rows["outs_DDD", "light"]["chain"] == "MULTI" and rows["outs_DDD", "light"]["cdr3_aa"] == "None"
    assert rows["outs_EEE", "heavy"]["clone_id"] == "outs_NA"
    every = readers.load_10x(spark, str(folder / "outs" / readers.TEN_X), "X", remove_nonproductive=False, keep_multi=True, null_missing_clones=True)
    assert every.columns == [*names(CONTIGS), "ord"]
    assert {r["cell_id"] for r in every.collect()} == {"X_AAA", "X_CCC", "X_DDD", "X_EEE"}
    assert every.filter("cell_id = 'X_EEE'").first()["clone_id"] is None
    with pytest.raises(FileNotFoundError):
        readers.load_10x(spark, str(tmp_path / "nothing"))
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="columns"):
        readers.load_10x(spark, str(tmp_path / "bad.csv"))


def test_airr(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("locus\tv_call\tj_call\tjunction_aa\tproductive\nIGH\tIGHV1\tIGHJ1\tCARW\tT\nIGK\tIGKV1\tIGKJ1\t\tT\nIGL\tIGLV1\tIGLJ1\tCSSF\tF\n")
    rows = readers.load_airr(spark, str(tmp_path / "a.tsv"), "S").collect()
    assert [(r["cell_id"], r["chain"], r["chain_type"], r["clone_id"]) for r in rows] == [("S_1", "IGH", "heavy", None)]
    assert readers.load_airr(spark, str(tmp_path / "a.tsv"), remove_nonproductive=False).count() == 2


def test_combined(spark):
    a = spark.createDataFrame([("x", "IGHV3-30.IGHD1-1.IGHJ4.CARGYSSGWYFDYW", "IGKV1-5.IGKJ2.CQQYNSYSF", "c1")], "barcode string, IGH string, IGLC string, CTstrict string")
    b = spark.createDataFrame([("y", None, "IGLV2-14.IGLJ1.CSSYTSSSTLVF", None), ("z", "IGHD.IGHV1.IGHJ6.CAR", "", None)], a.schema)
    rows = {(r["cell_id"], r["chain"]): r for r in readers.load_combined([a, b]).collect()}
    assert set(rows) == {("x", "IGH"), ("x", "IGK"), ("y", "IGL")}
    assert rows["x", "IGH"]["d_gene"] == "IGHD1-1" and rows["x", "IGK"]["d_gene"] is None
    assert rows["x", "IGH"]["sample_id"] == "S1" and rows["y", "IGL"]["sample_id"] == "S2"
    single = readers.load_combined(a.drop("barcode")).collect()
    assert {r["cell_id"] for r in single} == {"S1_1"}


def test_units_epitopes_structures(spark, tmp_path):
    with gzip.open(tmp_path / "u.csv.gz", "wt") as f:
        f.write('"{""Run"": 1}"\nlocus,cdr3_aa,v_call,j_call\nH,CARDW,IGHV1,IGHJ1\nH,CAX*W,IGHV1,IGHJ1\nH,,IGHV2,IGHJ1\nH,CAREW,IGHV2,IGHJ2\n')
    assert reference.read_unit(spark, str(tmp_path / "u.csv.gz")).count() == 4
    assert {r["cdr3_aa"] for r in reference.read_sequences(spark, str(tmp_path)).collect()} == {"CARDW", "CAREW"}
    assert reference.read_sequences(spark, str(tmp_path), 1).count() == 1
    record = {"linear_sequence": "PEP", "parent_source_antigen_name": "spike", "source_organism_name": "Virus A", "receptor_chain1_cdr3_seqs": ["ARDW", None, "AREF"], "receptor_chain2_cdr3_seqs": [], "pdb_id": "1abc", "assay_names": "binding"}
    (tmp_path / "e.json").write_text(json.dumps([record, record | {"source_organism_name": "other", "receptor_chain1_cdr3_seqs": [None]}]))
    rows = reference.read_epitopes(spark, str(tmp_path / "e.json"), "virus").collect()
    assert [(r["cdr3h"], r["cdr3l"], r["organism"]) for r in rows] == [("ARDW;AREF", None, "Virus A")]
    (tmp_path / "s.tsv").write_text("PDB\tHchain_cdr3\tantigen\n9xyz\tCARDW\tHA\n")
    (row,) = reference.read_structures(spark, str(tmp_path / "s.tsv")).collect()
    assert (row["pdb_id"], row["cdr3h"], row["antigen"], row["vh"]) == ("9xyz", "CARDW", "HA", None)
    known = annotate.known_specificities(reference.read_epitopes(spark, str(tmp_path / "e.json")), reference.read_structures(spark, str(tmp_path / "s.tsv")))
    assert {(r["cdr3h"], r["cdr3h_canon"]) for r in known.collect()} == {("ARDW", "ARD"), ("AREF", "ARE"), ("CARDW", "ARD")}


def test_reference_round_trip_and_command_line(spark, tmp_path):
    out = build_references.main(["--species", "mouse", "--n", "300", "--out", str(tmp_path / "refs"), "--cache", str(tmp_path / "cache")])
    assert out == [f"{tmp_path}/refs/mouse"]
    loaded = reference.load_reference(spark, str(tmp_path / "refs"), "mouse")
    assert loaded.sequences.count() == 300 and loaded.kmer_freq.filter("k = 4").count() > 100
    with pytest.raises(FileNotFoundError):
        reference.load_reference(spark, str(tmp_path / "refs"), "human")


def test_command_line_reads_units_whole(spark, tmp_path):
    """More rows than UNIT_LINES in a unit, and a number of sequences above them all."""
    with gzip.open(tmp_path / "u.csv.gz", "wt") as f:
        f.write('"{""Run"": 1}"\nlocus,cdr3_aa,v_call,j_call\n' + "H,CARDW,IGHV1,IGHJ1\n" * (reference.UNIT_LINES + 50))
    build_references.main(["--species", "mouse", "--n", "100000000", "--units", str(tmp_path / "u.csv.gz"), "--out", str(tmp_path / "refs"), "--cache", str(tmp_path / "cache")])
    assert reference.load_reference(spark, str(tmp_path / "refs"), "mouse").kmer_freq.first()["n_total"] == reference.UNIT_LINES + 50


@pytest.mark.parametrize("n", [1, 700, 3000, 5000])
def test_samples_are_the_smallest_hashes(spark, n):
    rows = reference.synthetic_sequences(spark, 3000)
    value = F.xxhash64("cdr3_aa", F.lit(1))
    found = reference._least_hashes(rows, value, n)
    assert sorted(found.collect()) == sorted(rows.orderBy(value, "cdr3_aa").limit(n).collect())


@pytest.mark.parametrize("chain", ["heavy", "both", "paired"])
def test_pipeline(spark, chain):
    ref = reference.build_reference(reference.synthetic_sequences(spark, 3000))
    ref.structures = spark.createDataFrame([("1abc", "CARDGYSSGWYAAA", None, "antigen", None, None, None, None)], ref.structures.schema)
    full = cluster_receptors(contigs(spark), ref, chain=chain, global_max_dist=1.0)
    stars = cluster_receptors(contigs(spark), ref, chain=chain, global_max_dist=1.0, full_edges=False, annotate=False)
    assert {tuple(r) for r in full.membership.collect()} == {tuple(r) for r in stars.membership.collect()}
    if full.membership.count():
        sizes = {r["cluster_id"]: r["n_members"] for r in full.clusters.collect()}
        assert min(sizes.values()) >= 3
    assert full.annotations.columns[:5] == ["cluster_id", "query_cdr3", "match_cdr3", "match_type", "distance"]
