"""Bucketed contents, carried head branches, and files from a folder."""

import pytest
from pyspark.sql import functions as F

from pullscan.model import VIOLATION_COLUMNS
from pullscan.operators import review as rv
from pullscan.sources import contents, derived, tables

CHANGES = "repo string, pr_number bigint, file_ord bigint, filename string, status string, patch string, head_branch string"


@pytest.fixture
def texts(spark):
    return spark.range(200).select(
        F.concat(F.lit("org/r"), (F.col("id") % 3).cast("string")).alias("repo"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"),
        F.lit("feature/1").alias("ref"), F.md5(F.col("id").cast("string")).alias("sha"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"),
    )


@pytest.fixture
def changes(spark):
    rows = [(f"org/r{i % 3}", i % 5, i, f"p{i}", "modified", "+x", "feature/1") for i in range(0, 220, 2)]
    return spark.createDataFrame(rows, CHANGES)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_contents_are_not_shuffled(spark, tmp_path, texts, changes, no_broadcast):
    path = str(tmp_path / "contents")
    contents.write_contents(texts, path, 5)
    prs = spark.createDataFrame([("org/r0", 1, "feature/1")], "repo string, pr_number bigint, head_branch string")
    table = contents.read_contents(spark, path)
    got = rv.file_at_ref(changes, prs, table)
    plan = plan_of(got)
    # One exchange, of the changed files by the key of the texts; nothing is moved by pull request.
    lines = [x for x in plan.splitlines() if "Exchange" in x]
    assert len(lines) == 1 and "ref" in lines[0] and "5)" in lines[0] and "pr_number" not in lines[0].split("hashpartitioning")[1]
    after = plan[plan.index("Bucketed: true") - 3000 : plan.index("Bucketed: true")]
    assert "SelectedBucketsCount: 5 out of 5" in plan and "Scan parquet" in after
    want = rv.file_at_ref(changes, prs, texts)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.where("content is null").count() == 10


def test_appended_buckets(spark, tmp_path, texts, changes, no_broadcast):
    path = str(tmp_path / "contents")
    contents.write_contents(texts.where("sha < '8'"), path, 4)
    contents.write_contents(texts.where("sha >= '8'"), path, 4, mode="append")
    table = contents.read_contents(spark, path)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, texts.collect()))
    keys = changes.select("repo", F.col("filename").alias("path"), F.col("head_branch").alias("ref"))
    some = contents.wanted_contents(table, keys.union(keys))
    assert some.count() == 100 and some.columns == table.columns
    assert plan_of(some).count("Exchange") == 1
    with pytest.raises(ValueError):
        contents.write_contents(texts, path, 7, mode="append")


def test_a_head_branch_that_is_not_carried_comes_from_the_pull_request(spark, texts, changes):
    prs = spark.createDataFrame([(f"org/r{r}", p, "feature/1") for r in range(3) for p in range(5)], "repo string, pr_number bigint, head_branch string")
    carried, joined = (rv.file_at_ref(c, prs, texts) for c in (changes, changes.drop("head_branch")))
    assert sorted(map(tuple, carried.select(joined.columns).collect())) == sorted(map(tuple, joined.collect()))


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes("é = 1\n".encode())
    (tmp_path / "bad.py").write_bytes(b"x\xff\xfey\xe2\x82")
    (tmp_path / "skip.bin").write_bytes(b"\x00")
    got = {r.path: r for r in tables.file_contents_from_files(spark, str(tmp_path), "org/a", "main", "*.py").collect()}
    assert {p: r.content for p, r in got.items()} == {"src/a.py": "é = 1\n", "bad.py": b"x\xff\xfey\xe2\x82".decode("utf-8", "replace")}
    assert got["bad.py"].repo == "org/a" and len(got["bad.py"].sha) == 40


def test_files_written_by_tasks(spark, tmp_path):
    """One file for each name, in folders that are listed by themselves; names are escaped, nothing half-written is left."""
    rows = [("d1", "a\nb"), ("d2", ""), ("d2", "again"), ("x/y %", "é"), (None, "n"), ("d3", None)]
    many = [(f"m{i}", f"text {i}") for i in range(500)]
    path = str(tmp_path / "out")
    tables.write_files(spark.createDataFrame(rows + many, "name string, text string").repartition(7), f"file://{path}")
    got = tables.file_contents_from_files(spark, path, "org/a", "main", "*.txt", tables.WRITTEN).collect()
    parts = [r.path.split("/") for r in got]
    assert all(p[0].startswith("folder=") and p[1].startswith("name=") and len(p) == 3 for p in parts)
    content = {p[1].removeprefix("name="): r.content for p, r in zip(parts, got, strict=True)}
    assert len(content) == len(got) == 505 and sorted(content.pop("d2").split("\n")) == ["", "", "again"]
    want = {"d1": "a\nb\n", "x%2Fy %25": "é\n", "__HIVE_DEFAULT_PARTITION__": "n\n", "d3": "\n", **{n: t + "\n" for n, t in many}}
    assert content == want
    assert not [f for f in (tmp_path / "out").rglob(".*") if f.suffix != ".crc"]


def test_no_files_written(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_files(spark.createDataFrame([], "name string, text string"), path)
    assert tables.file_contents_from_files(spark, path, "org/a", "main", "*.txt", tables.WRITTEN).count() == 0


def test_folders_are_read_by_tasks(spark, tmp_path):
    """The driver holds folders, not files; what is read is what Spark's own scan finds."""
    for name in ("f=1/a/x.txt", "f=1/_h/x.txt", "f=1/.h/x.txt", "f=2/_x=1/y.txt", "f=2/_x=1/_z.txt", "f=2/y.txt._COPYING_", "f=3/é x%20.txt", "f=3/q.TXT", "g=4/g.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() + b"\xff")
    (tmp_path / "f=3" / "empty.txt").touch()
    (tmp_path / "f=3" / "link").symlink_to(tmp_path / "f=1" / "a")
    (tmp_path / "f=5").mkdir()
    for glob in ("*.txt", "?.txt", None):
        got = tables.file_contents_from_files(spark, f"file:{tmp_path}/", "org/a", "main", glob, "f=*")
        assert "binaryFile" not in plan_of(got) and not got.inputFiles()
        scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob or "*")
        want = scan.load(f"{tmp_path}/f=*")
        want = want.select(F.substring_index("path", f"{tmp_path}/", -1), F.sha1("content"), F.make_valid_utf8(F.col("content").cast("string")))
        assert sorted(map(tuple, got.select("path", "sha", "content").collect())) == sorted(map(tuple, want.collect()))


def test_the_snapshot_moves_texts_by_their_own_key_only(spark, texts, changes, no_broadcast):
    """Names of pull requests that repeat multiply their files, unknown ones drop them; a file without a text has none."""
    prs = spark.createDataFrame([("org/r0", 0, "h1"), ("org/r0", 0, "h2"), ("org/r1", 1, "h3"), (None, 2, "h4")], "repo string, pr_number bigint, head_branch string")
    done = spark.createDataFrame([("org/r0", 0, "p0", True, "new"), ("org/r1", 1, "p16", False, "no")], "repo string, pr_number bigint, filename string, success boolean, refactored_code string")
    fields = ", ".join(f"{c} {'int' if c in ('line', 'column', 'seq', 'rule_ord') else 'string'}" for c in ("repo", "file", *[c for c in VIOLATION_COLUMNS if c != "file"], "seq", "rule_ord"))
    found = spark.createDataFrame([], f"pr_number bigint, {fields}")
    more = spark.createDataFrame([("org/r0", 1, 998, "gone", "modified", "+x", "feature/1"), (None, 2, 999, None, "modified", "+x", "feature/1")], changes.schema)
    wide = changes.unionByName(more.where("file_ord = 999")).unionByName(changes.where("file_ord = 0"))
    snap = tables.handoff_snapshot(wide, prs, texts, done, found, F.lit("t"))
    got = sorted((r.branch, r.filename, r.original_code, r.refactored_code) for r in tables.restore_snapshot(snap, F.lit("")).collect())
    files = [("h1", "p0"), ("h2", "p0"), *((h, f"p{i}") for i in range(0, 220, 2) if i % 5 == 0 and i % 3 == 0 for h in ("h1", "h2")), *(("h3", f"p{i}") for i in range(0, 220, 2) if i % 5 == 1 and i % 3 == 1)]
    want = sorted((b, p, f"text {p[1:]}" if int(p[1:]) < 200 else None, "new" if p == "p0" else None) for b, p in files)
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
    # Nothing is exchanged above the join with the texts.
    plan = plan_of(snap).splitlines()
    join = next(i for i, x in enumerate(plan) if "Join" in x)
    assert "ref" in plan[join] and not [x for x in plan[:join] if "Exchange" in x]


def test_commit_records_are_packed(spark, tmp_path):
    commits = spark.range(5000).select(
        F.lit("org/a").alias("repo"), (F.col("id") % 7).alias("pr_number"), F.col("id").alias("commit_ord"), F.md5(F.col("id").cast("string")).alias("sha")
    )
    records = tables.snapshot_commits(commits, commits.where("commit_ord % 4 = 0"))
    path = tmp_path / "snapshot"
    tables.write_snapshot_commits(records, str(path))
    size = sum(f.stat().st_size for f in path.glob("part-*"))
    assert size * 3 < records.selectExpr("sum(length(value) + 1)").first()[0]
    back, plain = (tables.restore_snapshot_commits(r) for r in (spark.read.text(str(path)), records))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, plain.collect())) and back.count() == 6250


def test_even_tables_are_not_dealt_again(spark, tmp_path):
    """A table of many even splits stays where it is, also where no patch is read; one of few splits is dealt to all cores."""
    docs = spark.range(0, 240).select(F.col("id").alias("doc_id"), F.concat(F.lit("One. Two "), F.col("id").cast("string")).alias("text"))
    docs.repartition(24).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        many, one = (derived.source_files(spark, str(tmp_path / k)) for k in ("many", "one"))
        assert "RoundRobin" not in plan_of(many) and "RoundRobin" in plan_of(one)
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
        assert "RoundRobin" in plan_of(derived.code_pairs(spark, str(tmp_path / "many")))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    keys = derived.file_changes(spark, str(tmp_path / "one"), patch=False)
    assert "text" not in plan_of(keys) and set(map(tuple, keys.collect())) == set(map(tuple, derived.file_changes(spark, str(tmp_path / "one")).select(keys.columns).collect()))
