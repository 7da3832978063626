"""A seeded random contig table: two contigs a cell, the first cells of each sample around shared cores."""

import random

SCHEMA = (
    "cell_id string, sample_id string, chain string, chain_type string, v_gene string, d_gene string, j_gene string, c_gene string, "
    "cdr3_aa string, cdr3_nt string, clone_id string, is_cell boolean, productive boolean, ord long"
)
CORES = ("CARDGYSSGWY", "CARGYSSGWY", "CARDGYSSGWF", "CAREVVAAGTDY", "CAREVVAAGTEY")
RESIDUES = "ARNDCQEGHILKMFPSTWYV"


def contigs(spark, cells=50, samples=2, seed=7):
    rng, rows = random.Random(seed), []
    for s in range(1, samples + 1):
        for i in range(1, cells + 1):
            cell, clone = f"S{s}_cell{i}", f"clone_{(i + 2) // 3}"
            some = lambda n: "".join(rng.choice(RESIDUES) for _ in range(n))
            heavy = CORES[i - 1] + some(3) if i <= 5 else "C" + some(rng.randint(10, 18)) + "W"
            rows.append((cell, f"S{s}", "IGH", "heavy", f"IGHV{rng.randint(1, 5)}-1", None, f"IGHJ{rng.randint(1, 3)}", None, heavy, None, clone, True, True, len(rows)))
            light = rng.choice(("IGK", "IGL"))
            rows.append((cell, f"S{s}", light, "light", f"{light}V{rng.randint(1, 3)}", None, f"{light}J1", None, "C" + some(rng.randint(8, 12)) + "F", None, clone, True, True, len(rows)))
    return spark.createDataFrame(rows, SCHEMA)
