"""Trees written and copied, with tasks that fail or run twice."""

import os

import pytest
from pyspark.sql import functions as F

from lexloom.sources import readers, trees


def listed(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def test_copy_equals_the_listed_tree(spark, tmp_path):
    files = {"a/b/one.md": b"1", "a/two.md": "é".encode(), "three.txt": b"", "a b/ü.md": b"x" * 300_000}
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary").repartition(3)
    made = trees.write_tree(df, f"{tmp_path}/tree")
    assert listed(f"{tmp_path}/tree") == files and {r["path"]: r["bytes"] for r in made.collect()} == {p: len(c) for p, c in files.items()}
    (tmp_path / "copy").mkdir()
    (tmp_path / "copy/old.md").write_text("goes")
    trees.copy_tree(spark, f"{tmp_path}/tree", f"{tmp_path}/copy", "*.md")
    assert listed(f"{tmp_path}/copy") == {p: c for p, c in files.items() if p.endswith(".md")}
    trees.write_tree(df.limit(0), f"{tmp_path}/none")
    assert listed(f"{tmp_path}/none") == {}


def test_small_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """Names and contents as Spark's readers give them, hidden files and folders left out; the number of tasks goes by files and bytes."""
    names = ["top.md", "v 1/a.md", "v 1/x%y#[1]?.md", "v 1/deep/er/ü.md", "v 1/deep/b.txt", "_no/a.md", ".no/a.md", "v 1/_h.md", "v 1/.h.md", "v=1/_k=1.md"] + [f"w/{i}.md" for i in range(200)]
    for n in names:
        (tmp_path / "t" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / n).write_bytes(f"{n} é".encode() if "a.md" not in n else b"\xff\x00")
    root = f"{tmp_path}/t"
    own = {(r["path"], r["raw_text"]) for r in readers.markdown_files(spark, root).select("path", F.col("raw_text").cast("binary")).collect()}
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("_metadata.file_path", F.col("value").cast("binary"))
    assert own == {tuple(r) for r in raw.collect()} and len(own) == 205
    for uri in (root, f"file:{root}", f"file://{root}/"):
        assert readers.markdown_files(spark, uri, folders="v.*").count() == 4
    for glob in ("*.md", "*", "{a,b}.*", "[0-9]?.md"):
        of = trees.list_tree(spark, root, glob)
        spark_own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        assert {(f"file:{root}/" + r["path"], r["content"]) for r in of.collect()} == {(r["path"], r["content"]) for r in spark_own.collect()}
    assert readers.markdown_files(spark, root).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(trees, "TASK_FILES", 10)
    assert trees.list_tree(spark, f"file://{root}", "*.md").rdd.getNumPartitions() == 21
    monkeypatch.setattr(trees, "BATCH_BYTES", 5)
    assert trees.list_tree(spark, root).count() == 206


def test_a_failed_run_leaves_the_target_and_a_second_one_the_whole(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}", bytearray(f"{i}".encode())) for i in range(30)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(5)
    trees.write_tree(df.limit(3), f"{tmp_path}/t")
    before = listed(f"{tmp_path}/t")
    broken = df.withColumn("content", F.when(F.col("path") == "d0/f27", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        trees.write_tree(broken, f"{tmp_path}/t")
    assert listed(f"{tmp_path}/t") == before  # the files of tasks that had ended are beside it
    trees.write_tree(df.union(df), f"{tmp_path}/t")  # each file twice, as of a task that ran again
    assert listed(f"{tmp_path}/t") == {p: bytes(c) for p, c in rows}


@pytest.mark.parametrize("path", ["/etc/x", "a/../../x", None])
def test_paths_stay_below_the_target(spark, tmp_path, path):
    with pytest.raises(Exception, match="below the target"):
        trees.write_tree(spark.createDataFrame([(path, bytearray(b"x"))], "path string, content binary"), f"{tmp_path}/t")
