"""Tables that cut lineage, kept in the folder the cluster shares.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and the session runs on
one machine (tests, a laptop) a temporary one is made; on a cluster that is an error, as each executor
would write to its own disk. A lost executor recomputes nothing that was written here. The tables of a
query are read until its result is written: :func:`working` deletes them afterwards.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of a working table, which a writing task holds in memory.
ROW_GROUP = 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []
_HELD: dict[str, dict] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="parlance-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back; later reads start from the files.

    The shuffle files of the writing job are deleted at its end, as nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/parlance-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The tables written so far and not released, oldest first."""
    return list(_WRITTEN)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of :func:`materialise`; DataFrames that read them are dead then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Within it queries are run and their results written; tables they materialised are deleted at its end."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        release(spark, [p for p in _WRITTEN if p not in before])


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that Python workers import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="parlance-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = os.path.join(folder, "parlance_shipped.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def held(owner: str) -> dict:
    """What a Python worker keeps between the tasks of one operator; what others kept goes.

    Workers live on through the stages of an application, so a large cache of one stage would
    count against the memory of all later ones.
    """
    for name in [n for n in _HELD if n != owner]:
        del _HELD[name]
    return _HELD.setdefault(owner, {})


def tidied(work):
    """``work`` over batches, giving memory back at a task's end: idle workers stay beside the next stage's tasks."""

    @wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return run
