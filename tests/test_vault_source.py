"""The vault data source: filters that reach the listing, a stream of changes, and writes that leave nothing half done."""

import time

import pytest
from notewell.sources import vault
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, Not, StringContains, StringEndsWith, StringStartsWith

NOTES = {"a/one.md": "one", "a/two.md": "two é", "b/deep/er/three.md": "three", "b/deep/x.txt": "no note", "c/four.md": "four", "secret/five.md": "five", "six.md": "six", ".vaultignore": "# hidden\nsecret/\n"}


@pytest.fixture()
def root(tmp_path):
    for rel, content in NOTES.items():
        (tmp_path / "v" / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / rel).write_text(content)
    return str(tmp_path / "v")


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(vault.VaultSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def read(reader):
    return sorted(rel for part in reader.partitions() for _, rel in part.paths)


REL = ("rel",)


@pytest.mark.parametrize(("filters", "want", "left"), [
    ([], ["a/one.md", "a/two.md", "b/deep/er/three.md", "c/four.md", "six.md"], 0), ([StringStartsWith(REL, "a/")], ["a/one.md", "a/two.md"], 0), ([StringStartsWith(REL, "b/de")], ["b/deep/er/three.md"], 0),
    ([EqualTo(REL, "c/four.md"), IsNotNull(REL)], ["c/four.md"], 0), ([In(REL, ("a/one.md", "a/none.md"))], ["a/one.md"], 0), ([Not(StringStartsWith(REL, "a/")), StringEndsWith(REL, "e.md")], ["b/deep/er/three.md"], 0),
    ([StringContains(REL, "o"), EqualTo(("content",), "two")], ["a/one.md", "a/two.md", "c/four.md"], 1), ([StringStartsWith(REL, "a/"), StringStartsWith(REL, "b/")], [], 0), ([StringStartsWith(REL, "none/at/all")], [], 0),
])
def test_filters_decide_which_files_are_read(root, filters, want, left):
    reader = vault.FilteredVaultReader(vault.Folder({"path": root}))
    assert len(list(reader.pushFilters(filters))) == left
    assert read(reader) == want


def test_folders_that_cant_hold_a_note_are_not_listed(root, monkeypatch):
    from pyarrow import fs

    listed = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def get_file_info(self, selector):
            listed.append(selector.base_dir.removeprefix(root).strip("/"))
            return self.inner.get_file_info(selector)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(vault.Folder, "open", lambda self: (Counted(fs.LocalFileSystem()), self.root))
    reader = vault.FilteredVaultReader(vault.Folder({"path": root}))
    list(reader.pushFilters([StringStartsWith(REL, "b/deep/")]))
    assert read(reader) == ["b/deep/er/three.md"] and sorted(listed) == ["b/deep", "b/deep/er"]
    listed.clear()
    assert len(read(vault.VaultReader(vault.Folder({"path": root})))) == 5 and "secret" not in listed


def test_filters_are_pushed_by_spark(spark, root):
    load = lambda: spark.read.format("vault").option("pushdown", "true").load(root)
    some = load().where(F.startswith("rel", F.lit("a/")) & (F.length("content") > 3))
    assert [tuple(r) for r in some.collect()] == [("a/two.md", "two é")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    # The scan has taken the condition on the path over; the other one is left to Spark.
    assert "StartsWith" not in plan and "isnotnull(rel" not in plan and "length(content" in plan
    assert load().where("rel = 'six.md' or rel = 'c/four.md'").count() == 2 and load().where("rel like 'a/%'").count() == 2 and load().count() == 5
    assert spark.read.format("vault").option("ignore", "false").load(root).count() == 6


def test_changes_come_as_a_stream(spark, root, tmp_path):
    def drain():
        query = spark.readStream.format("vault").option("settle", "200").load(root).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    time.sleep(0.4)
    first = drain()
    assert [rel for rel, _ in first] == ["a/one.md", "a/two.md", "b/deep/er/three.md", "c/four.md", "six.md"]
    (tmp_path / "v" / "a" / "one.md").write_text("one again")
    (tmp_path / "v" / "new.md").write_text("new")
    time.sleep(0.4)
    assert set(drain()) - set(first) == {("a/one.md", "one again"), ("new.md", "new")}


def left_over(root):
    import pathlib

    return sorted(str(p.relative_to(root)) for p in pathlib.Path(root).rglob("*") if p.is_file() and str(p.relative_to(root)) not in NOTES and not str(p.relative_to(root)).startswith(vault.STAGED))


def test_notes_are_written(spark, root):
    made = spark.range(20).select(F.concat(F.lit("new/n"), F.col("id") % 3, F.lit("/"), "id", F.lit(".md")).alias("rel"), F.concat(F.lit("note "), "id").alias("content")).repartition(4)
    made.write.format("vault").mode("append").save(root)
    assert {tuple(r) for r in spark.read.format("vault").load(root).where("rel like 'new/%'").collect()} == {tuple(r) for r in made.collect()}
    assert len(left_over(root)) == 20
    changed = spark.createDataFrame([("new/n0/0.md", "changed"), ("six.md", None)], "rel string, content string")
    with pytest.raises(Exception, match="there already"):
        changed.write.format("vault").mode("append").save(root)
    changed.write.format("vault").mode("overwrite").save(root)
    got = dict(map(tuple, spark.read.format("vault").load(root).collect()))
    twice = spark.createDataFrame([("new/x.md", "1"), ("new/./x.md", "2")], "rel string, content string").repartition(2, "content")
    with pytest.raises(Exception, match="written twice"):
        twice.write.format("vault").mode("overwrite").save(root)
    assert got["new/n0/0.md"] == "changed" and got["six.md"] == "" and got["new/n1/1.md"] == "note 1" and len(left_over(root)) == 20


@pytest.mark.parametrize("bad", ["out/../../x.md", "/abs.md", "new/no-note.txt", "six.md"])
def test_a_failed_write_leaves_no_file(spark, root, bad):
    rows = [(f"new/{i}.md", "x") for i in range(30)] + [(bad, "y")]
    with pytest.raises(Exception, match=r"no path of a note|there already"):
        spark.createDataFrame(rows, "rel string, content string").repartition(3).write.format("vault").mode("append").save(root)
    assert left_over(root) == []
