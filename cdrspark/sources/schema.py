"""Fixed output schemas."""

CONTIGS = (
    "cell_id string, sample_id string, chain string, v_gene string, d_gene string, j_gene string, c_gene string, "
    "cdr3_aa string, cdr3_nt string, clone_id string, is_cell boolean, productive boolean, chain_type string"
)
BACKGROUND = "cdr3_aa string, v_gene string, j_gene string, chain string"
EPITOPES = "epitope_seq string, antigen string, organism string, cdr3h string, cdr3l string, assay string, pdb_id string"
STRUCTURES = "pdb_id string, cdr3h string, cdr3l string, antigen string, antigen_type string, vh string, vl string, resolution string"
FREQUENCIES = "k int, kmer string, count long, freq double, per_seq double, n_total long"


def names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]
