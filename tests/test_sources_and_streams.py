"""Trees that are walked, searched by an index, and followed as they change."""

import os

import pytest
from pyspark.sql import functions as F

from codelake import samples
from codelake.operators import entry_points, search_index, text_search
from codelake.sources import files as source
from codelake.sources import tree
from codelake.streaming import file_tables


def plant(root, files):
    for path, text in files:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tree_is_read_as_by_the_plain_reader(spark, tmp_path):
    plant(tmp_path, samples.PROJECT + [("deep/" + "/".join("abcdefgh") + "/X.java", "class X { }\n"), ("a b/Ä.java", "﻿class A { }"), ("x.txt", "no")])
    got, want = source.read_tree(spark, [str(tmp_path)]), source.read_files(spark, str(tmp_path))
    assert rows(got) == rows(want) and got.count() == len(samples.PROJECT) + 1  # one lies in a folder of build output
    nested = source.read_tree(spark, [str(tmp_path), str(tmp_path / "src/main"), str(tmp_path)])
    assert rows(nested) == rows(got)
    assert source.read_tree(spark, [str(tmp_path / "none")]).count() == 0


def test_pruned_folders_are_never_listed(tmp_path, monkeypatch):
    plant(tmp_path, [(f"m{i}/{d}/deep/A.java", "x") for i in range(3) for d in ("src", "node_modules", ".git", "target/classes")])
    opened, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(str(p)) or scandir(p))
    reader = tree.TreeReader({"path": os.pathsep.join([str(tmp_path), str(tmp_path / "m1")])})
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[1] for r in got) == [f"m{i}/src/deep/A.java" for i in range(3)]
    assert not [p for p in opened if any(x in p for x in ("node_modules", ".git", "target"))] and any(p.endswith("deep") for p in opened)
    os.symlink(tmp_path, tmp_path / "m0/loop")
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 3
    with pytest.raises(ValueError):
        tree.TreeReader({})


def test_index_finds_what_a_search_finds(spark, tmp_path):
    texts = [("p", f"d{i // 40}/F{i}.java", f"public void get{i}() {{\n  call(x{i % 7});\n}}\n" + ("Straße ÄÖ\n" if i % 90 == 0 else "")) for i in range(400)] + [("p", "e/Empty.java", ""), ("p", "e/Null.java", None), ("p", "e/Two.java", "ab")]
    files = spark.createDataFrame(texts, "project string, path string, text string")
    folder = str(tmp_path / "index")
    search_index.write_index(files, folder, 8)
    for query in ("get12", "GET123()", "call(x3)|get1", "äö", "STRASSE|Straße", "ab", "nowhere at all", "x"):
        got, want = search_index.search(spark, folder, query), text_search.search(source.as_files(files.where("text IS NOT NULL")), query)
        assert rows(got) == rows(want), query
    few = search_index.found_files(spark, folder, ["get123()"])
    assert few.count() < 10
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert search_index.candidates(spark, folder, ["get123()"]).select("bucket").distinct().count() < 8


def test_stream_of_changing_files_equals_the_batch(spark, tmp_path):
    root, target, checkpoint = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "state")
    plant(root, samples.PROJECT)

    def look():
        file_tables.time_to_settle()
        file_tables.run(file_tables.file_stream(spark, [str(root)]), target, checkpoint).awaitTermination()
        files = source.read_tree(spark, [str(root)])
        for name, f in file_tables.OPERATORS.items():
            want = f(files)
            assert rows(file_tables.latest(spark, target, name).select(*want.columns)) == rows(want), name
        return entry_points.rest_map(files).count()

    assert look() == 2
    plant(root, [(f"{samples.HOME}OrderController.java", samples.CONTROLLER.replace('"/orders")', '"/all")').replace("@PostMapping", "// @PostMapping")), (f"{samples.HOME}Late.java", samples.JOBS), (f"{samples.HOME}Jobs.java", "class Jobs { }\n")])
    assert look() == 1
    assert look() == 1  # nothing new
    kinds = file_tables.latest(spark, target, "entry-points").where(F.col("file") == f"{samples.HOME}Jobs.java")
    assert kinds.count() == 0
