"""Tables that cut lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset and driver and executors are one process, as in tests, a folder made here;
    on a cluster such a folder would be another one on each machine, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cdrspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and a lost executor loses none of it."""
    path = shared_path(df.sparkSession, name)
    for scope in _SCOPES.get():
        scope.append(path)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


#: Lists of the paths that are written while a scope is open. Each thread has its own scopes.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing will read again."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that this thread writes inside. Queries whose results are read later leave their working
    tables; with this and discard() a caller who has read a result deletes them."""
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield paths
    finally:
        _SCOPES.reset(token)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those given to the function that this yields."""
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.table_path)
        return table

    with recorded() as paths:
        try:
            yield keep
        finally:
            discard(spark, [p for p in paths if p not in kept])
