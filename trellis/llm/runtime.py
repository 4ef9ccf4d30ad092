"""What the operators share: the shared folder, staged tables, shipped code."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
FILE_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trellis-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str, gather: bool = True) -> str:
    """Folder below the shared one that ``df`` is written to, as Parquet.

    A plan of few bytes goes into few files: no more than the cluster's cores or one for
    each ``FILE_BYTES`` that Catalyst expects, whichever is more.
    """
    path = new_folder(spark, name)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = max(spark.sparkContext.defaultParallelism, size // FILE_BYTES)
    (df.coalesce(files) if gather and files < 2**31 else df).write.parquet(path)
    return path


def staged(spark: SparkSession, df: DataFrame, name: str, gather: bool = True) -> DataFrame:
    """``df`` written once in the shared folder and read again: cuts its lineage there."""
    return spark.read.schema(df.schema).parquet(written(spark, df, name, gather))


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    to = Path(tempfile.mkdtemp(prefix="trellis-code-")) / "trellis_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        z.write(root / "trellis" / "__init__.py", "trellis/__init__.py")
        for p in sorted((root / "trellis" / "llm").glob("*.py")):
            z.write(p, str(p.relative_to(root)))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


class Memory(dict):
    """What ``make`` gave for keys before. When full, all goes to ``old``, whence keys in use come back."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        got = self[key] = self.make(key) if got is None else got
        return got


@contextlib.contextmanager
def plain_objects():
    """Without the cycle collector: for loops that make many small objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; a worker that waits for its next task, maybe another operator's, holds no free memory meanwhile."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batches, rows: int = 256):
    """Record batches a few rows at a time, so that Python objects of a few texts exist at once. Nothing is copied."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def column(name: str) -> Column:
    """A column by its exact name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def struct_of(names: tuple[str, ...] | list[str]) -> Column:
    """Those columns in one struct, under their own names."""
    return F.struct(*map(column, names))


def filesystem(uri: str):
    """pyarrow's file system and path for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
