"""The paged library source and the staging sink."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfmark.sources import paged, staged


def _land(root, pages):
    for (library, page), n in pages.items():
        folder = root / f"library={library}" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "part-0.json").write_text("{bad" if n is None else json.dumps({"results": [{"id": f"{library}-{page}-{k}"} for k in range(n)]}))


def test_pages_until_the_first_short_one(spark, tmp_path):
    _land(tmp_path, {**{("a", p): 3 for p in range(9)}, ("a", 9): 1, **{("b", p): 3 for p in (0, 1, 3, 4)}, ("c", 0): 3, ("c", 1): None, ("c", 2): 3, ("d", 0): 0, **{("e", p): 3 for p in range(12)}})
    paged.register(spark)
    read = lambda **o: spark.read.format("library_pages").options(size="3", range="2", **o).load(str(tmp_path))
    got = {r["library"]: r["n"] for r in read(lastPage="7").groupBy("library").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 24, "b": 6, "c": 3, "e": 24}
    assert read().filter("library = 'a'").count() == 28
    assert sorted(r["id"] for r in read().filter("library = 'c'").select(F.get_json_object("json", "$.id").alias("id")).collect()) == ["c-0-0", "c-0-1", "c-0-2"]
    assert read().filter("library = 'nowhere'").count() == 0


def test_pages_past_the_five_hundredth_are_read_and_none_over_and_over(spark, tmp_path, monkeypatch):
    _land(tmp_path, {**{("a", p): 2 for p in range(510)}, **{("b", p): 2 for p in (0, 1, 3)}, ("c", 0): 1, ("c", 1): 2})
    got = {r["library"]: r["n"] for r in paged.load(spark, str(tmp_path), size="2").groupBy("library").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 1020, "b": 4, "c": 1}
    assert paged.load(spark, str(tmp_path), ["b", "nowhere"], size="2", lastPage="0").count() == 2
    read, results = [], paged.PagedReader._results
    monkeypatch.setattr(paged.PagedReader, "_results", lambda self, library, page: read.append((library, page)) or results(self, library, page))
    reader = paged.PagedReader({"path": str(tmp_path), "size": "2", "ends": '{"b": 2, "c": 0}'})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 1025 and len(read) == len(set(read)) == 510 + 3 + 1


def test_the_library_filter_is_pushed_down(spark, tmp_path):
    _land(tmp_path, {("a", 0): 3, ("b", 0): 3})
    paged.register(spark)
    df = spark.read.format("library_pages").option("size", "3").load(str(tmp_path)).filter("library in ('a') and page >= 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 3 and df.rdd.getNumPartitions() == 1
    assert " = a)" not in plan and ">= 0)" in plan, "Spark filters by page, the source by library"
    reader = paged.PagedReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([paged.EqualTo(("library",), "a"), paged.EqualTo(("page",), 0)]))
    assert len(left) == 1 and [p.library for p in reader.partitions()] == ["a"]


def _files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_staging_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path)
    staged.register(spark)
    (tmp_path / "1-a").mkdir()
    (tmp_path / "1-a" / "cover.png").write_bytes(b"old")
    rows = spark.createDataFrame([(f"{root}/{k}-a/metadata.json", f"{k}".encode()) for k in range(20)] + [(f"{root}/1-a/cover.jpg", b"new")], "path string, content binary").repartition(4)
    dies = F.udf(lambda p: 1 / 0 if p.endswith("/19-a/metadata.json") else p, "string")
    with pytest.raises(Exception, match="division by zero"):
        rows.coalesce(1).withColumn("path", dies("path")).write.format("staged_files").mode("append").save(root)
    assert _files(root) == ["1-a/cover.png"]
    for _ in range(2):
        rows.write.format("staged_files").mode("append").save(root)
        assert _files(root) == sorted([f"{k}-a/metadata.json" for k in range(20)] + ["1-a/cover.jpg"])
    assert (tmp_path / "7-a" / "metadata.json").read_bytes() == b"7" and (tmp_path / "1-a" / "cover.jpg").read_bytes() == b"new"


def test_a_repeated_task_and_a_lost_driver(tmp_path):
    root = str(tmp_path)
    rows = [Row(path=f"{root}/{k}/metadata.json", content=b"x") for k in range(3)]
    writer = staged.StagedWriter(root)
    writer.write(iter(rows))  # this attempt is lost with its executor
    message = writer.write(iter(rows))

    def dying():
        yield rows[0]
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writer.write(dying())
    assert not any(f.startswith("0/") for f in _files(root))
    writer.commit([message, None])
    assert _files(root) == [f"{k}/metadata.json" for k in range(3)]
    left = staged.StagedWriter(root)
    told = left.write(iter([Row(path=f"{root}/9/metadata.json", content=b"y")]))
    (tmp_path / left.job / staged.MARK).write_text(told.listed)
    other = staged.StagedWriter(root)
    other.write(iter([Row(path=f"{root}/8/metadata.json", content=b"z")]))
    assert staged.recover(root) == 1
    assert _files(root) == [f"{k}/metadata.json" for k in (0, 1, 2, 9)]
    with pytest.raises(ValueError):
        staged.StagedWriter(root).write(iter([Row(path=f"{root}/../x", content=b"")]))
