"""Fixed values of the method: defaults, residue groups, substitution costs."""

# Defaults of the published method.
KMER_SIZES = (4, 5)
MAX_DISTANCE = 2.0
LENGTH_DIFF = 1
MIN_COUNT = 3
MAX_FRACTION = 0.20
MIN_FOLD = 10.0
P_CUTOFF = 0.05
MIN_CLUSTER_SIZE = 3
LOUVAIN_MIN_NODES = 50
ANNOTATION_MAX_DISTANCE = 1.0
MIN_CDR3, MAX_CDR3 = 5, 35
HEAVY_WEIGHT, LIGHT_WEIGHT = 0.7, 0.3
GAP_COST = 0.5

# Physico-chemical residue groups and their tokens.
GROUPS = {"hydrophobic": "AVILMFWP", "polar": "STNQYC", "positive": "RHK", "negative": "DE", "special": "G"}
TOKEN_OF = {aa: f"[{group}]" for group in GROUPS.values() for aa in group}

# BLOSUM62 pairs with a positive score (cost 0) and with score 0 (cost 0.5); all others cost 1.
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
FREE_PAIRS = "AS RQ RK ND NH NS DE QE QK EK HY IL IM IV LM LV MV FW FY ST WY"
# Every free pair, and every residue of one with itself, once: residues of a sequence : those of another that they match at no cost.
FREE_BLOCKS = "AS:AS ST:T T:S NS:N N:DHS H:HNY D:DEN E:DKQ EKQ:E KQR:KQR FWY:FWY Y:H ILMV:ILMV"
HALF_PAIRS = "AC AG AT AV RN RE RH NQ NE NG NK NT DQ DS QH QM QS EH ES GS IF LF KS MF TV"
