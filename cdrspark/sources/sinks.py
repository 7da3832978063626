"""Results as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdrspark.operators.clusters import Result
from cdrspark.operators.motifs import with_member_ids


def _csv(df: DataFrame, path: str, join_arrays: bool) -> str:
    """df as a folder of CSV parts with headers; array columns joined by semicolons, or left out."""
    arrays = [n for n, kind in df.dtypes if kind.startswith("array")]
    out = df.select(*[(F.array_join(c, ";").alias(c) if c in arrays else F.col(c)) for c in df.columns if join_arrays or c not in arrays])
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_clusters(result: Result, prefix: str = "results", folder: str = ".") -> list[str]:
    """<prefix>_clusters.csv and _membership.csv, and _motifs.csv and _annotations.csv if they have rows; the paths."""
    base = f"{folder.rstrip('/')}/{prefix}"
    paths = [_csv(result.clusters, f"{base}_clusters.csv", False), _csv(result.membership, f"{base}_membership.csv", False)]
    if not result.motifs.isEmpty():
        motifs = result.motifs if result.members is None else with_member_ids(result.motifs, result.members)
        paths.append(_csv(motifs, f"{base}_motifs.csv", True))
    if result.annotations is not None and not result.annotations.isEmpty():
        paths.append(_csv(result.annotations, f"{base}_annotations.csv", False))
    return paths
