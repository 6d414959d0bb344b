"""Objects in files of any layout, cut at any place, and files of one object each."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.sources import object_files, objects, outline_files
from quire.sources.object_files import OneFileEach, OneFileEachWriter


def outline(name, n, rng):
    return {"doc": name, "title": rng.choice(["T {[ \" \\", "é", "", "}{"]), "outline": [
        {"level": "H1", "text": f'a "quoted" {{ \\ {i}', "page": i} for i in range(n)]}


def read(spark, path):
    good, bad = outline_files.read_outlines(spark, str(path))
    return {r.doc: (r.title, None if r.outline is None else [(e.text, e.page) for e in r.outline]) for r in good.collect()}, sorted(r.record for r in bad.collect())


def expected(found):
    return {o["doc"]: (o["title"], [(e["text"], e["page"]) for e in o["outline"]]) for o in found}


def test_several_objects_of_a_file(spark, tmp_path):
    rng = random.Random(1)
    made = [outline(f"d{i}", i % 4, rng) for i in range(8)]
    (tmp_path / "several.json").write_text("\n".join(json.dumps(o, indent=i) for i, o in enumerate(made[:2])))
    (tmp_path / "cut.jsonl").write_text("\n".join(json.dumps(o) for o in made[2:4]) + '\n{"doc": "x", "title": "b')
    (tmp_path / "one line.json").write_text(json.dumps(made[4]) + " " + json.dumps(made[5]))
    (tmp_path / "list.json").write_text(json.dumps(made[6:], indent=2))
    found, bad = read(spark, tmp_path)
    assert found == expected(made) and bad == ['{"doc": "x", "title": "b']


@pytest.mark.parametrize("broken", [
    '{"doc": "x", "title": "b', '{"doc": "x", "outline": [{"level": "H1"}', '{"doc": "x", "outline": [', '{"doc": "x", ', "words", "}", "]]", '{"doc": "x"}}',
    '{\n "doc": "x",\n "title": "open', '{"doc"',
])
def test_a_broken_object_costs_no_other(spark, tmp_path, broken):
    rng = random.Random(2)
    made = [outline(f"d{i}", 2, rng) for i in range(4)]
    texts = [json.dumps(made[0]), json.dumps(made[1], indent=1), broken, json.dumps(made[2]), json.dumps(made[3], indent=3)]
    (tmp_path / "all.json").write_text("\r\n".join(texts))
    found, bad = read(spark, tmp_path)
    assert {d: v for d, v in found.items() if d != "x"} == expected(made)
    assert len(bad) == 1


def test_cut_at_every_place(spark, tmp_path):
    """Whatever splits a file is read in, its objects and broken records are the same."""
    rng = random.Random(3)
    made = [outline(f"d{i}", i % 3, rng) for i in range(12)]
    parts = [json.dumps(o, indent=rng.choice([None, 0, 2])) for o in made]
    parts.insert(5, '{"doc": "broken", "outline": [{"level": "H2"}')
    parts.insert(9, "no object")
    (tmp_path / "all.json").write_text("\n".join(parts) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (7, 40, 97, 300, 1000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            found, bad = read(spark, tmp_path)
            assert found == expected(made) and bad == ["no object", '{"doc": "broken", "outline": [{"level": "H2"}'], size
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        (tmp_path / "all.json").write_text(json.dumps({k: v for k, v in made[2].items() if k != "doc"}, indent=1))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
        assert list(read(spark, tmp_path)[0]) == ["all"]  # an object over several splits is all of its file
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_skeleton_and_names():
    assert objects.skeleton('{"a\\"{": [1, true], "b": "x}') == "{s:[s,s],s:s"
    assert list(objects.pieces('{"a":1},{"b":2}\njunk {"c"\n{"d": 3}')) == ['{"a":1}', '{"b":2}', 'junk {"c"', '{"d": 3}']
    names = ["plain", "a b", "a/b", "a%2Fb", ".hidden", "_x", "é", "x" * 400, "", "a\nb", "c:d"]
    files = [object_files.file_name(name) for name in names]
    assert len(set(files)) == len(names) and files[:2] == ["plain.json", "a b.json"]
    assert all("/" not in name and len(name.encode()) < 256 and name[0] not in "._" or name == ".json" for name in files)


def test_one_file_for_each_document(spark, tmp_path):
    names = ["plain", "a b", "a/b", "a%2Fb", ".hidden", "_x", "ü", "x" * 400, "c:d", "50% off", "n+1"]
    df = spark.createDataFrame(
        [(name, f"T {name[:9]}", [("H1", "α β", 2)]) for name in names], "doc string, title string, outline array<struct<level:string,text:string,page:int>>"
    )
    path = tmp_path / "out"
    outline_files.write_outline_files(df.repartition(3), str(path))
    found, bad = read(spark, path)
    assert set(found) == set(names) and bad == [] and found["a b"] == ("T a b", [("α β", 2)])
    assert json.loads((path / "a b.json").read_text()) == {"title": "T a b", "outline": [{"level": "H1", "text": "α β", "page": 2}]}
    assert len(list(path.iterdir())) == len(names)
    outline_files.write_outline_files(df.filter("doc in ('plain', 'a/b')"), str(path))
    assert sorted(read(spark, path)[0]) == ["a/b", "plain"]
    with pytest.raises(Exception, match="without a name"):
        outline_files.write_outline_files(df.withColumn("doc", F.lit(None).cast("string")), str(path))
    assert sorted(p.name for p in path.iterdir()) == ["a%2Fb.json", "plain.json"]


def test_only_committed_attempts_count(tmp_path):
    writer = OneFileEachWriter(str(tmp_path / "out"), overwrite=False)
    rows = [("a", "1"), ("b", "2")]
    first, second = writer.write(iter(rows)), writer.write(iter(rows))  # the second is speculative

    def lost():
        yield "a", "half"
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(lost())
    other = writer.write(iter([("c", "3")]))
    assert first != second
    writer.commit([first, other, None])
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.json": "1", "b.json": "2", "c.json": "3"}
    again = OneFileEachWriter(str(tmp_path / "out"), overwrite=True)
    again.abort([again.write(iter([("a", "new")]))])
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.json": "1", "b.json": "2", "c.json": "3"}
    assert OneFileEach.name() == "one_file_each"


def test_small_files_are_opened_once(spark, tmp_path):
    """The scan for fragments lists no file that Spark never cuts."""
    for at in range(30):
        (tmp_path / f"f{at}.json").write_text('{"a": %d}' % at)
    found = objects.read_objects(spark, str(tmp_path))
    assert sorted((r.file, r.value, r.whole) for r in found.collect()) == sorted((f"f{at}.json", '{"a": %d}' % at, True) for at in range(30))
    plan = objects.read_objects(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan text" in line]
    assert len(scans) == 2 and sum(bool(re.search(r"DataFilters: \[\(file_size#\d+L > ", scan)) for scan in scans) == 1


def test_small_files_are_not_listed_by_the_driver(spark, tmp_path):
    """Nor are names of all files held when a sink's files are moved."""
    for at in range(40):
        (tmp_path / f"f {at}%.json").write_bytes(b'\xef\xbb\xbf{"a":\r\n %d}\r' % at)
    for name in ("_x.json", ".y.json", "empty.json"):
        (tmp_path / name).write_text('{"no": 1}' if name != "empty.json" else "")
    (tmp_path / "b=.json").write_text('{"b": 1} {"c": 2}')
    found = objects.read_objects(spark, str(tmp_path))
    assert sorted((r.file, json.loads(r.value)["a"], r.whole) for r in found.filter("file != 'b=.json'").collect()) == sorted((f"f {at}%.json", at, True) for at in range(40))
    assert [(r.value, r.whole) for r in found.filter("file = 'b=.json'").orderBy("value").collect()] == [('{"b": 1}', False), ('{"c": 2}', False)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan text" in line]
    assert scans and all("InMemoryFileIndex(0 paths)" in scan for scan in scans)
    (tmp_path / "folder").mkdir()  # where folders lie in it, Spark lists
    assert objects.read_objects(spark, str(tmp_path)).count() == 42
    import pickle
    assert pickle.loads(__import__("pyspark").cloudpickle.dumps(object_files._names))  # goes with the job
    assert [len(part) for part in object_files._names(object_files.fs.LocalFileSystem(), str(tmp_path), 30)] == [30, 14]
