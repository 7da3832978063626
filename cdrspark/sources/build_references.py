"""spark-submit entry that builds references: --species --n --cores --out --cache --force, and the input files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cdrspark.sources import reference as R


def main(argv: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--species", default="human,mouse", help="comma-separated")
    p.add_argument("--n", type=int, default=R.DEFAULT_SEQUENCES)
    p.add_argument("--cores", type=int, default=0, help="local cores, if no master is set")
    p.add_argument("--out", default="references")
    p.add_argument("--cache", default="references/cache")
    p.add_argument("--force", action="store_true")
    p.add_argument("--units", default=None, help="gzipped sequence units; {species} is replaced; without it the background is synthetic")
    p.add_argument("--epitopes", default=None, help="epitope JSON")
    p.add_argument("--structures", default=None, help="structure TSV")
    a = p.parse_args(argv)
    builder = SparkSession.builder.appName("build-references")
    spark = (builder.master(f"local[{a.cores}]") if a.cores else builder).getOrCreate()
    epitopes = R.cached_epitopes(spark, a.cache, a.epitopes, force=a.force) if a.epitopes else None
    structures = R.cached_structures(spark, a.cache, a.structures, force=a.force) if a.structures else None
    out = []
    for species in a.species.split(","):
        units = a.units.replace("{species}", species) if a.units else None
        # The number of sequences is --n alone: units are read whole.
        sequences = R.cached_sequences(spark, a.cache, units, species, a.n, a.force, max_lines=None)
        out.append(R.save_reference(R.build_reference(sequences, epitopes, structures, species), a.out))
    return out


if __name__ == "__main__":
    print("\n".join(main()))
