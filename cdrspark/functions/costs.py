"""Substitution costs and the distance kernels on Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cdrspark.functions.constants import AMINO_ACIDS, FREE_BLOCKS, FREE_PAIRS, GAP_COST, HALF_PAIRS


def cost_table() -> np.ndarray:
    """(256, 256) costs by byte: 0 for equal bytes, 0 or 0.5 for the listed pairs, else 1."""
    table = np.ones((256, 256), np.float32)
    np.fill_diagonal(table, 0)
    for pairs, cost in ((FREE_PAIRS, 0.0), (HALF_PAIRS, 0.5)):
        for a, b in pairs.split():
            table[ord(a), ord(b)] = table[ord(b), ord(a)] = cost
    return table


COSTS = cost_table()
PLAIN = (~np.eye(256, dtype=bool)).astype(np.float32)
#: The blocks of FREE_BLOCKS, named by letters, that a residue of a sequence (first) and one of another (second) are in. Two residues
#: have one block in common if they match at no cost, else none; one in no block stands for itself.
BLOCKS_OF = [{c: "".join(chr(97 + i) for i, b in enumerate(FREE_BLOCKS.split()) if c in b.split(":")[side]) for c in sorted({*FREE_BLOCKS} - {*": "})} for side in (0, 1)]


def cost_matrix() -> dict[tuple[str, str], float]:
    """Costs between the twenty standard residues."""
    return {(a, b): float(COSTS[ord(a), ord(b)]) for a in AMINO_ACIDS for b in AMINO_ACIDS}


def read_score_matrix(text: str) -> dict[tuple[str, str], int]:
    """Scores of a substitution matrix in the usual text format (comments, a header of letters, a row for each letter)."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    head = rows[0]
    return {(r[0], c): int(v) for r in rows[1:] for c, v in zip(head, r[1:], strict=True)}


def costs_of(scores: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """The rule behind the cost tables: 1 below zero, 0.5 at zero, 0 above it and for equal letters."""
    return {(a, b): 0.0 if a == b or v > 0 else 0.5 if v == 0 else 1.0 for (a, b), v in scores.items()}


def weighted(a: str, b: str) -> float:
    """Sum of the costs position by position, up to the end of the shorter."""
    return float(sum(COSTS[ord(x) & 255, ord(y) & 255] for x, y in zip(a, b, strict=False)))


def gapped(a: str, b: str) -> float:
    """Lengths that differ by one: the best single deletion in the longer, plus the gap's cost; otherwise infinite."""
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) > 1:
        return float("inf")
    return min(weighted(short, long[:g] + long[g + 1 :]) for g in range(len(long))) + GAP_COST if long else float("inf")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, where each value begins, and lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), offsets[:-1], np.diff(offsets)


def position_costs(a: pa.Array, b: pa.Array, shift: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, positions) costs of a[p] against b[p + shift], 0 beyond either end; and which places count."""
    (data_a, at_a, len_a), (data_b, at_b, len_b) = _bytes(a), _bytes(b)
    width = int(len_a.max(initial=0))
    p = np.arange(width)
    inside = (p < len_a[:, None]) & (p + shift < len_b[:, None])
    x = data_a[np.where(inside, at_a[:, None] + p, 0)]
    y = data_b[np.where(inside, at_b[:, None] + p + shift, 0)]
    return np.where(inside, table[x, y], np.float32(0)), inside


def distances(a: pa.Array, b: pa.Array, table: np.ndarray = COSTS) -> np.ndarray:
    """Row by row: the weighted distance for equal lengths, the gapped one for lengths that differ by one, else infinite.

    The gapped minimum over deletions is one over prefix sums without shift plus suffix sums with shift."""
    out = np.full(len(a), np.inf)
    len_a, len_b = _bytes(a)[2], _bytes(b)[2]
    if (at := np.flatnonzero(len_a == len_b)).size:
        i = pa.array(at)
        out[at] = position_costs(a.take(i), b.take(i), 0, table)[0].sum(axis=1, dtype=np.float64)
    for first, second, at in ((a, b, np.flatnonzero(len_b - len_a == 1)), (b, a, np.flatnonzero(len_a - len_b == 1))):
        if at.size:
            i = pa.array(at)
            short, long = first.take(i), second.take(i)
            straight, moved = (position_costs(short, long, s, table)[0].astype(np.float64) for s in (0, 1))
            before = np.concatenate([np.zeros((len(at), 1)), np.cumsum(straight, axis=1)], axis=1)
            after = np.concatenate([np.cumsum(moved[:, ::-1], axis=1)[:, ::-1], np.zeros((len(at), 1))], axis=1)
            # Beyond a short string's end nothing is added, so those deletions repeat the last one.
            out[at] = (before + after).min(axis=1) + GAP_COST
    return out
