"""Exact tails as Arrow UDFs, and multiple-testing corrections over range partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdrspark.operators.tables import written


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Natural logarithm of n! for non-negative whole numbers: a table, then Stirling's series."""
    n = np.asarray(n, np.float64)
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 32)))])
    z = np.maximum(n, 31) + 1
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(n < 31, table[np.minimum(n, 31).astype(np.int64)], series)


def _tail(log_term, first: int, last: int) -> float:
    """Sum of exp(log_term(i)) for i from first to last, until terms no longer count; 1 at most."""
    total, top, lo, step = 0.0, -np.inf, first, 64
    while lo <= last:
        t = log_term(np.arange(lo, min(last, lo + step - 1) + 1))
        lo, step = lo + step, min(4096, 4 * step)
        new = max(top, float(t.max()))
        total = total * np.exp(top - new) + float(np.exp(t - new).sum()) if np.isfinite(new) else total
        top = new
        if t[-1] < top - 45 and t[-1] <= t[0]:
            break
    return float(min(1.0, np.exp(top) * total)) if total else 0.0


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X >= x) of a binomial."""
    if x <= 0 or p >= 1:
        return 1.0
    if x > n or p <= 0:
        return 0.0
    log_n = log_factorial(np.array(n))
    return _tail(lambda i: log_n - log_factorial(i) - log_factorial(n - i) + i * np.log(p) + (n - i) * np.log1p(-p), x, n)


def hypergeometric_tail(a: int, draws: int, good: int, total: int) -> float:
    """P(X >= a) of the number of good ones among the draws."""
    lowest, highest = max(0, draws + good - total), min(draws, good)
    if a <= lowest:
        return 1.0
    if a > highest:
        return 0.0
    f = log_factorial
    whole = f(np.array(total)) - f(np.array(draws)) - f(np.array(total - draws))

    def term(i: np.ndarray) -> np.ndarray:
        return f(np.array(good)) - f(i) - f(good - i) + f(np.array(total - good)) - f(draws - i) - f(total - good - draws + i) - whole

    return _tail(term, a, highest)


@F.pandas_udf(T.DoubleType())
def binomial_p(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Tests with the same counts and share have the same tail: each of them once."""
    each, back = np.unique(np.stack([np.asarray(v, np.float64) for v in (x, n, p)], axis=1), axis=0, return_inverse=True)
    return pd.Series(np.array([binomial_tail(int(a), int(b), float(c)) for a, b, c in each], np.float64)[back.ravel()])


@F.pandas_udf(T.DoubleType())
def hypergeometric_p(a: pd.Series, draws: pd.Series, good: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_tail(*map(int, t)) for t in zip(a, draws, good, total, strict=True)], dtype="float64")


def simes_bounds(p: np.ndarray) -> np.ndarray:
    """For j from 1 to n the smallest of j * s[n - j + k - 1] / k over k up to j, of the sorted values s: the level at which
    the j largest are no longer all kept together. With points (rank, value) it is j times the smallest slope seen from
    (n - j, 0), which a tangent of the lower hull of the points right of it has: n log n steps in all."""
    s = np.sort(np.asarray(p, np.float64)).tolist()
    n = len(s)
    out = np.empty(n)
    hull: list[tuple[int, float]] = []  # from right to left
    for j in range(1, n + 1):
        x, y = n - j + 1, s[n - j]
        while len(hull) > 1 and (hull[-1][1] - y) * (hull[-2][0] - x) >= (hull[-2][1] - y) * (hull[-1][0] - x):
            hull.pop()
        hull.append((x, y))
        lo, hi = 0, len(hull) - 1
        while lo < hi:  # slopes seen from the left fall and then rise along the hull
            mid = (lo + hi) // 2
            if hull[mid][1] * (hull[mid + 1][0] - (n - j)) <= hull[mid + 1][1] * (hull[mid][0] - (n - j)):
                hi = mid
            else:
                lo = mid + 1
        out[j - 1] = j * hull[lo][1] / (hull[lo][0] - (n - j))
    return out


def hommel(p: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
    """Hommel's adjusted values: the level up to which some j with bounds[j - 1] and j * p above it keeps p. The bounds fall
    with j and the products rise, so the two numbers where they cross decide."""
    p = np.asarray(p, np.float64)
    bounds = simes_bounds(p) if bounds is None else bounds
    if not len(p) or not len(bounds):
        return p.copy()
    lo, hi = np.zeros(len(p), np.int64), np.full(len(p), len(bounds))
    while (lo < hi).any():  # the first j (from 0) with (j + 1) * p >= bounds[j]
        mid = (lo + hi) // 2
        up = np.where(mid < len(bounds), (mid + 1) * p < bounds[np.minimum(mid, len(bounds) - 1)], False)
        lo, hi = np.where((lo < hi) & up, mid + 1, lo), np.where((lo < hi) & ~up, mid, hi)
    at = np.minimum(lo, len(bounds) - 1)
    return np.minimum(np.maximum(np.minimum(bounds[at], (at + 1) * p), np.where(lo > 0, np.minimum(bounds[np.maximum(lo - 1, 0)], lo * p), 0.0)), 1.0)


#: What one test gives, before the running minimum or maximum; and which of the two it takes, from which side.
STEPS = {"BH": "behind", "BY": "behind", "hochberg": "behind", "holm": "before"}
METHODS = ("none", "bonferroni", *STEPS, "hommel")


def adjusted(df: DataFrame, p: str, method: str, into: str, tie: list[str], most_tests: int = 20_000_000) -> DataFrame:
    """df with p adjusted over all its rows.

    Ranks come from a range partitioning: rows are numbered inside their part, and one row a part carries how many lie
    before it and the best value behind or before it. Only hommel brings the values (8 bytes each, most_tests at most, else an error) to the
    driver; there are no more tests than k-mers."""
    if method not in METHODS:
        raise ValueError(f"no such correction: {method}")
    if method == "none":
        return df.withColumn(into, F.col(p))
    if method in ("bonferroni", "hommel"):
        df = written(df, "tests")
    if method == "bonferroni":
        m = df.agg(F.count("*").alias("adj_m"))  # one row
        return df.crossJoin(F.broadcast(m)).withColumn(into, F.least(F.lit(1.0), F.col(p) * F.col("adj_m"))).drop("adj_m")
    if method == "hommel":
        if df.count() > most_tests:
            raise ValueError(f"more than {most_tests} tests; raise most_tests if the driver can hold them, or use another correction")
        sent = df.sparkSession.sparkContext.broadcast(simes_bounds(df.select(p).toPandas()[p].to_numpy(np.float64)))

        @F.pandas_udf(T.DoubleType())
        def value(x: pd.Series) -> pd.Series:
            return pd.Series(hommel(x.to_numpy(np.float64), sent.value))

        return df.withColumn(into, value(p))
    parts = written(written(df, "tests").repartitionByRange(F.col(p), *tie).withColumn("adj_part", F.spark_partition_id()), "ranked")
    up = Window.partitionBy("adj_part").orderBy(F.col(p), *tie)
    sizes = parts.groupBy("adj_part").agg(F.count("*").alias("n"))
    # One row a part, as many as there are shuffle partitions.
    every = Window.orderBy("adj_part")
    sizes = sizes.select("adj_part", (F.sum("n").over(every) - F.col("n")).alias("adj_from"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("adj_m"))
    ranked = parts.withColumn("adj_in", F.row_number().over(up)).join(F.broadcast(sizes), "adj_part")
    rank, m = F.col("adj_from") + F.col("adj_in"), F.col("adj_m")
    if method == "BY":
        harmonic = F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / i)
        factors = written(sizes.withColumn("adj_sum", harmonic), "harmonic").select("adj_part", "adj_sum")
        ranked = ranked.join(F.broadcast(factors), "adj_part")
        one = F.col("adj_sum") * F.col(p) * m / rank
    else:
        one = F.col(p) * m / rank if method == "BH" else F.col(p) * (m - rank + 1)
    ranked = ranked.withColumn("adj_one", one)
    behind = STEPS[method] == "behind"
    best = F.min if behind else F.max
    # Rows behind are read backwards: a frame that grows is kept up to date, one that shrinks is summed anew for each row.
    down = Window.partitionBy("adj_part").orderBy(F.desc(p), *[F.desc(c) for c in tie])
    rows = (down if behind else up).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = Window.orderBy("adj_part").rowsBetween(1, Window.unboundedFollowing) if behind else Window.orderBy("adj_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranked.groupBy("adj_part").agg(best("adj_one").alias("adj_best"))
    ends = ends.select("adj_part", best("adj_best").over(beyond).alias("adj_beyond"))
    both = ranked.join(F.broadcast(ends), "adj_part")
    pick = F.least if behind else F.greatest  # both pass over nulls
    value = F.least(F.lit(1.0), pick(best("adj_one").over(rows), F.col("adj_beyond")))
    return both.withColumn(into, value).select(*[F.col(f"`{c}`") for c in df.columns], into)
