"""What the operators of this subpackage share: tables in the shared folder, hashing, array kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cdrspark.operators.tables import discard, recorded, scratch, shared_path, written

__all__ = ["discard", "from_texts", "give_back", "id_remainder", "mixed", "recorded", "remembered", "scratch", "shared_path", "slices", "spread_join", "written"]


#: Keys that are sent to every executor at most: those with the most rows.
SENT_KEYS = 100_000
#: Rows that Arrow moves at once at most: two workers and their executor hold a few such batches of long texts.
BATCH_ROWS = 2000


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def spread_join(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with a table of different keys, whatever share of the rows has one key. Keys with more than total /
    SENT_KEYS rows (in column size, which is dropped), SENT_KEYS at most, are sent to every executor; the others are joined by a shuffle in which none has more."""
    least = total // SENT_KEYS + 1
    rest, big = table.filter(F.col(size) <= least).drop(size), table.filter(F.col(size) > least).drop(size)
    known = rows.join(F.broadcast(big), key)
    if big.isEmpty():
        return rows.join(rest, key)
    return known.unionByName(rows.join(F.broadcast(big.select(key)), key, "left_anti").join(rest, key))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit integers to well-spread 64-bit integers, another family member for each seed."""
    step = np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: What a Python worker remembers from task to task, by name.
_MEMORY: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]) -> object:
    """One object for a name and Python worker, made when it is first asked for."""
    if name not in _MEMORY:
        _MEMORY[name] = make()
    return _MEMORY[name]


def give_back(memory: str = "") -> None:
    """Forget what other operators remember, and give free memory back to the system: a worker lives through
    many tasks of many stages, beside others in an executor."""
    for name in [n for n in _MEMORY if n != memory]:
        del _MEMORY[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `most` bytes of a text or binary column, or of the first one in a struct (or one longer
    row); of other columns, whole."""
    values = batch.column(column)
    if pa.types.is_struct(values.type):
        values = values.flatten()[0]
    if not (pa.types.is_string(values.type) or pa.types.is_binary(values.type)):
        yield batch
        return
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    at = 0
    while at < len(values):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def from_texts(df: DataFrame, made: dict[str, str], start: Callable[[], Callable[[list], dict[str, list]]], column: str = "text", keep: bool = False, slice_bytes: int = 4_000_000, memory: str = "") -> DataFrame:
    """df with the columns `made` (name: type), which replace those of the same names, and without the
    text column unless `keep`. start() is called once a task and gives the function from a list of texts
    to the lists of values; memory names what they remember. Arrow batches of the session get BATCH_ROWS rows at most: the setting is
    read when the result runs, so it stays. Other columns pass through as Arrow arrays and keep their exact values."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made])
    carried = [f for f in df.schema if keep or f.name != column]
    new = T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in made.items()))
    schema = T.StructType(carried + list(new))
    names, kinds = [f.name for f in carried], [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(memory)
        function = start()
        for batch in batches:
            for piece in slices(batch, column, slice_bytes):
                out = function(piece.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in names] + [pa.array(out[f.name], k) for f, k in zip(new, kinds, strict=True)], names=schema.fieldNames())
                del out, piece
            del batch
        # The worker may stay idle beside stages that need the executor's memory.
        del function
        give_back(memory)

    return df.mapInArrow(run, schema)
