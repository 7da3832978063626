"""Column expressions on receptor sequences and chain names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cdrspark.functions.constants import TOKEN_OF


def standardise_chain(x: Column) -> Column:
    """IGH, IGK or IGL for the usual names, the upper-cased name for any other."""
    up = F.upper(x)
    return F.when(up.isin("IGH", "HEAVY"), "IGH").when(up.isin("IGK", "KAPPA"), "IGK").when(up.isin("IGL", "LAMBDA"), "IGL").otherwise(up)


def chain_type(chain: Column) -> Column:
    """heavy for IGH, light for every other name, null for null."""
    return F.when(chain.isNull(), F.lit(None).cast("string")).when(chain == "IGH", "heavy").otherwise("light")


def canonical(cdr3: Column) -> Column:
    """Upper case without outer spaces, one leading C and one trailing W or F."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(cdr3)), "^C", ""), "[WF]$", "")


def kmers(sequence: Column, k: int) -> Column:
    """All k-mers in order, none of shorter or null sequences."""
    starts = F.sequence(F.lit(1), F.length(sequence) - (k - 1))
    return F.when(F.length(sequence) >= k, F.transform(starts, lambda i: F.substring(sequence, i, k))).otherwise(F.array().cast("array<string>"))


def masked(kmer: Column, k: int) -> Column:
    """The k-mer with each single position in turn replaced by its residue group; unknown letters give no token."""
    token = F.create_map(*[F.lit(x) for pair in TOKEN_OF.items() for x in pair])

    def at(p: int) -> Column:
        return F.concat(F.substring(kmer, 1, p), token[F.substring(kmer, p + 1, 1)], F.substring(kmer, p + 2, k))

    return F.array_compact(F.array_distinct(F.array(*[at(p) for p in range(k)])))


def chain_parts(text: Column) -> dict[str, Column]:
    """v, d, j, cdr3 of a dotted chain string; the last token that fits wins, each token fits its first rule."""
    tokens = F.split(text, r"\.")
    v, d, j = "^IG[HKL]V", "^IGHD", "^IG[HKL]J"

    def last(rule) -> Column:
        fits = F.filter(tokens, rule)
        return F.when(F.size(fits) > 0, F.element_at(fits, -1))

    return {
        "v_gene": last(lambda t: t.rlike(v)),
        "d_gene": last(lambda t: t.rlike(d) & ~t.rlike(v)),
        "j_gene": last(lambda t: t.rlike(j) & ~t.rlike(f"{v}|{d}")),
        "cdr3_aa": last(lambda t: t.rlike("^C[A-Z]") & (F.length(t) > 5) & ~t.rlike(f"{v}|{d}|{j}")),
    }


def is_true(x: Column) -> Column:
    """The spellings of true and false that table readers of the field accept; anything else is null."""
    text = x.cast("string")
    return F.when(text.isin("TRUE", "True", "true", "T"), True).when(text.isin("FALSE", "False", "false", "F"), False)
