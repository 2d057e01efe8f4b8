"""Folders kept alike: listed with sizes and digests, compared by name, and copied or removed in tasks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.files import folders

_LIST = "name string, length long, modificationTime timestamp, md5 string"
_OUT = "name string, action string, length long, md5 string, error string"
_BLOCK = 8 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """A folder with its scheme, without a slash at its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def _there(spark: SparkSession, root: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def listing(spark: SparkSession, path: str, glob: str = "*", digest: bool = True) -> DataFrame:
    """``name`` (from the folder on), ``length, modificationTime, md5`` of the files in a folder and below it; ``md5`` is null, and no file is read, without ``digest``.

    The folders in the folder are listed in tasks, one each with all below it; then the files are dealt by name and read
    in blocks. Files and folders whose names begin with a dot or ``_``, as those that are being written, are left out.
    A folder that is not there has no files.
    """
    if not _there(spark, path):
        return spark.createDataFrame([], _LIST)
    root = qualified(spark, path)
    parts = [("",), *((f,) for f in folders(spark, path) if f[0] not in "._")]
    n = spark.sparkContext.defaultParallelism
    found = spark.createDataFrame(parts, "part string").repartition(max(n, len(parts)), "part").mapInPandas(_listed(root, glob), _LIST)
    return found.repartition(n, "name").mapInPandas(_digested(root), _LIST) if digest else found


def _listed(root: str, glob: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(_uri(root))
        for pdf in batches:
            for part in pdf["part"]:
                inside = f"{base}/{part}" if part else base
                found = [(f.path[len(base) + 1 :], f.size, pd.Timestamp(f.mtime)) for f in files.get_file_info(fs.FileSelector(inside, recursive=bool(part))) if f.type == fs.FileType.File]
                rows = [r for r in found if fnmatchcase(r[0].rsplit("/", 1)[-1], glob) and not any(x[0] in "._" for x in r[0].split("/"))]
                out = pd.DataFrame({"name": [r[0] for r in rows], "length": [r[1] for r in rows], "md5": [None] * len(rows)}, dtype=object)
                yield out.assign(modificationTime=pd.to_datetime([r[2] for r in rows], utc=True))

    return run


def _digested(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(_uri(root))
        for pdf in batches:
            sums = []
            for name in pdf["name"]:
                one = hashlib.md5()
                with files.open_input_stream(f"{base}/{name}") as read:
                    while block := read.read(_BLOCK):
                        one.update(block)
                sums.append(one.hexdigest())
            yield pdf.assign(md5=pd.Series(sums, index=pdf.index, dtype=object))

    return run


def compared(source: DataFrame, target: DataFrame) -> DataFrame:
    """``name, action, length, md5`` of two listings: ``copy`` (new or different), ``keep`` (equal) or ``extra`` (in the target alone).

    Files are equal if size and digest are; without digests, if the sizes are and the target's is not older.
    """
    t = target.select("name", F.col("length").alias("__l"), F.col("modificationTime").alias("__t"), F.col("md5").alias("__d"))
    both = source.join(t, "name", "full_outer")
    alike = (F.col("length") == F.col("__l")) & F.coalesce(F.col("md5") == F.col("__d"), F.col("__t") >= F.col("modificationTime"))
    action = F.when(F.col("length").isNull(), "extra").when(F.coalesce(alike, F.lit(False)), "keep").otherwise("copy")
    return both.select("name", action.alias("action"), F.coalesce("length", "__l").alias("length"), F.coalesce("md5", "__d").alias("md5"))


def _uri(root: str) -> str:
    scheme, _, rest = root.partition(":")
    return f"{scheme}://{quote(rest)}" if rest.startswith("/") and not rest.startswith("//") else f"{scheme}:{quote(rest)}"


def _carried_out(source: str, target: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        (a, a_root), (b, b_root) = (fs.FileSystem.from_uri(_uri(r)) for r in (source, target))

        def copy(name: str, length: int) -> str:
            to = f"{b_root}/{name}"
            folder, last = to.rsplit("/", 1)
            part = f"{folder}/.{last}.{uuid.uuid4().hex}.part"  # attempts of a task that was lost don't meet
            b.create_dir(folder, recursive=True)
            sum_, n = hashlib.md5(), 0
            try:
                with a.open_input_stream(f"{a_root}/{name}") as read, b.open_output_stream(part) as write:
                    while block := read.read(_BLOCK):
                        sum_.update(block)
                        write.write(block)
                        n += len(block)
                if n != length:
                    raise OSError(f"{n} of {length} bytes")
                b.move(part, to)
            except BaseException:
                if b.get_file_info(part).type == fs.FileType.File:
                    b.delete_file(part)
                raise
            return sum_.hexdigest()

        for pdf in batches:
            out = []
            for name, action, length in zip(pdf["name"], pdf["action"], pdf["length"]):
                try:
                    if action == "copy":
                        out.append((name, action, length, copy(name, length), None))
                    else:
                        if b.get_file_info(f"{b_root}/{name}").type == fs.FileType.File:
                            b.delete_file(f"{b_root}/{name}")
                        out.append((name, "delete", length, None, None))
                except Exception as e:  # noqa: BLE001  (a file that fails is a row; the next run finds it again)
                    out.append((name, action if action == "copy" else "delete", length, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["name", "action", "length", "md5", "error"], dtype=object)

    return run


def synced(spark: SparkSession, source: str, target: str, glob: str = "*", digest: bool = True, delete: bool = False, report: str | None = None) -> DataFrame:
    """Make ``target`` hold the files of ``source``; gives ``name, action, length, md5, error`` of all files.

    Equal files are neither copied nor written. A file is written under another name and renamed, so a reader finds the old or the
    new one, and a run that died is made whole by the next. Files in the target alone stay (``extra``), or go with ``delete``.
    The work is done when the report is written: to ``report`` as Parquet, or else when the rows that come back are read, each time.
    A folder inside the other is refused.
    """
    a, b = qualified(spark, source), qualified(spark, target)
    if f"{a}/".startswith(f"{b}/") or f"{b}/".startswith(f"{a}/"):
        raise ValueError("source and target are one folder, or one lies in the other")
    if not _there(spark, source):
        raise FileNotFoundError(source)
    plan = compared(listing(spark, source, glob, digest), listing(spark, target, glob, digest))
    work = F.col("action").isin("copy", "extra") if delete else F.col("action") == "copy"
    todo = plan.filter(work).repartition(spark.sparkContext.defaultParallelism, "name")
    out = todo.select("name", "action", "length").mapInPandas(_carried_out(a, b), _OUT).unionByName(plan.filter(~work).withColumn("error", F.lit(None).cast("string")))
    if report is None:
        return out
    out.write.mode("overwrite").parquet(report)
    return spark.read.schema(_OUT).parquet(report)
