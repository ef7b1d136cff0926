"""Trees of files, written and copied in parallel and committed by one rename."""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import settled

#: Bytes and files that a task reads about, and bytes of the batches that it hands on.
TASK_BYTES, TASK_FILES, BATCH_BYTES = 1 << 26, 5000, 1 << 23


def _opened(uri: str):  # noqa: ANN202
    """File system and path of a URI; one without a scheme, or of scheme file, is local or mounted on every machine."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_tree(files: DataFrame, target: str) -> DataFrame:
    """path, bytes and sha256 of the files (path below target, content binary) after they're all in place.

    Tasks write into a folder beside the target, each file under a name of its own that a rename makes final, so a
    task that is run again leaves a file once. Only when all have ended does one rename put the folder in the target's
    place, which is wiped first; a run that is broken off before that leaves the target as it was. Paths must be
    relative and stay below the target. On a cluster the target must be a folder that all machines share.
    """
    spark = files.sparkSession
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, root = _opened(staging)
        made = set()
        for batch in batches:
            paths, sizes, digests = [], [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if path is None or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} isn't below the target")
                data = content.as_py() or b""
                final = f"{root}/{path}"
                folder = final.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                own = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(data)
                store.move(own, final)
                paths.append(path)
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["path", "bytes", "sha256"])

    manifest = files.select("path", "content").mapInArrow(run, "path string, bytes long, sha256 string")
    manifest.write.parquet(f"{staging}.manifest")
    where = spark._jvm.org.apache.hadoop.fs.Path
    final, own = where(target), where(staging)
    store = final.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(final, True)
    store.mkdirs(own)  # no files, no folder yet
    if not store.rename(own, final):
        raise OSError(f"{staging} couldn't be put in place of {target}")
    return spark.read.schema(manifest.schema).parquet(f"{staging}.manifest")


def local_root(root: str) -> str | None:
    """The path of a folder that is local or mounted on every machine; None for what Spark's own readers must open."""
    path = root.removeprefix("file:") if root.startswith("file:") else root
    path = "/" + path.lstrip("/") if root.startswith("file:") or root.startswith("/") else os.path.abspath(path)
    return path if "://" not in root.removeprefix("file://") and not re.search(r"[*?\[\]{}\\]", path) and os.path.isdir(path) else None


def _hidden(name: str) -> bool:
    """As Spark's readers have it."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(deep: bool):  # noqa: ANN202
    """A task's listing of folders, with all below them or only their own entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = batch.column("path").to_pylist()
            rows: list[tuple[str, bool, int]] = []
            while todo:
                with os.scandir(todo.pop()) as entries:
                    for e in entries:
                        if _hidden(e.name):
                            continue
                        folder = e.is_dir()
                        if deep and folder:
                            todo.append(e.path)
                        else:
                            rows.append((e.path, folder, 0 if folder else e.stat().st_size))
                        if len(rows) >= 10_000:
                            yield _batch(rows)
                            rows = []
            yield _batch(rows)

    return run


def _batch(rows: list[tuple[str, bool, int]]) -> pa.RecordBatch:
    path, folder, size = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(folder, pa.bool_()), pa.array(size, pa.int64())], ["path", "folder", "size"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path and content, some megabytes at a time."""
    for batch in batches:
        paths, found, held = [], [], 0
        for path in batch.column("path").to_pylist():
            with open(path, "rb") as file:
                paths.append(path)
                found.append(file.read())
            held += len(found[-1])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.binary())], ["path", "content"])
                paths, found, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.binary())], ["path", "content"])


def read_below(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path (absolute) and content of the files below a local or mounted folder whose name fits the pattern.

    Tasks list the folders right below root and read the files, which are dealt by number and size: Spark's readers list
    a tree in the driver and take every small file for four megabytes, so that many of them make very many tasks.
    """
    kind = "path string, folder boolean, size long"
    top = settled(spark.createDataFrame([(root,)], "path string").coalesce(1).mapInArrow(_listed(False), kind), "listing")
    n = top.where("folder").count()
    below = top.where("folder").select("path").repartition(max(1, min(n, 1000)), "path").mapInArrow(_listed(True), kind)
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    files = top.where("NOT folder").union(below).where(F.substring_index("path", "/", -1).rlike(rf"\A(?s:{pattern})\z"))
    files = settled(files.select("path", "size"), "listing")
    whole = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(whole["n"], spark.sparkContext.defaultParallelism), math.ceil(whole["bytes"] / TASK_BYTES), math.ceil(whole["n"] / TASK_FILES))
    return files.select("path").repartition(tasks, "path").mapInArrow(_contents, "path string, content binary")


def list_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path below root and content of every file whose name fits the pattern."""
    local = local_root(root)
    if local is not None:
        return read_below(spark, local, glob).select(F.expr(f"substring(path, {len(local.rstrip('/')) + 2})").alias("path"), "content")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select(F.substring_index("path", root.rstrip("/").removeprefix("file:").lstrip("/") + "/", -1).alias("path"), "content")


def copy_tree(spark: SparkSession, source: str, target: str, glob: str = "*") -> DataFrame:
    """The files of source under the same paths below target; returns what ``write_tree`` does."""
    return write_tree(list_tree(spark, source, glob), target)
