"""The stream's tables: equal to a batch, once for each version, and the same after a batch runs again."""

import shutil

import pytest
from pyspark.sql import functions as F

from pullscan.operators import review as rv
from pullscan.rules.config import load_rules
from pullscan.sources.reviewlog import event_rows, read_review_log, write_review_log
from pullscan.streaming import review as st

TEXT = "def F(x):\n    except:\npassword = 'x'"


@pytest.fixture
def files(make_files):
    return make_files(*[(f"f{i}.py", TEXT) for i in range(8)]).withColumn("head_sha", F.lit("s"))


def started(spark, tmp_path, schema, state="state", **how):
    s = st.read_file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    q = st.start_review(s, load_rules(), str(tmp_path / "out"), str(tmp_path / state), once=True, **how)
    q.awaitTermination()


def deliver(files, tmp_path):
    files.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def tables(spark, tmp_path):
    root = str(tmp_path / "out")
    v = sorted(map(tuple, st.read_violations(spark, root).collect()))
    e = sorted((r.event, r.file or "", r.rule_id or "", r.line or 0, str(r.timestamp)) for r in st.read_events(spark, root).collect())
    return v, e


def test_stream_equals_batch(spark, tmp_path, files):
    for _ in range(2):  # the same versions delivered twice, in two batches
        deliver(files, tmp_path)
    started(spark, tmp_path, files.schema)
    got = st.read_violations(spark, str(tmp_path / "out"))
    want = rv.analyze(files, load_rules())
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    log = st.read_events(spark, str(tmp_path / "out")).groupBy("event").count().collect()
    n = want.count()
    assert {r.event: r["count"] for r in log} == {"review_started": 1, "pr_fetched": 1, "rule_triggered": n, "comment_generated": n, "review_completed": 1}


def test_versions_of_one_batch(spark, tmp_path, files):
    """A version delivered three times inside one batch counts once; another version of the file counts by itself."""
    deliver(files.union(files).union(files).union(files.limit(3).withColumn("head_sha", F.lit("t"))), tmp_path)
    started(spark, tmp_path, files.schema)
    assert st.read_violations(spark, str(tmp_path / "out")).count() == rv.analyze(files, load_rules()).count() // 8 * 11
    assert spark.read.parquet(str(tmp_path / "out" / "keys")).count() == 11


def test_without_versions_each_delivery_counts(spark, tmp_path, files):
    deliver(files.union(files), tmp_path)
    started(spark, tmp_path, files.schema, version=None)
    assert st.read_violations(spark, str(tmp_path / "out")).count() == 2 * rv.analyze(files, load_rules()).count()


def test_a_batch_that_runs_again_leaves_the_same_tables(spark, tmp_path, files):
    deliver(files, tmp_path)
    started(spark, tmp_path, files.schema)
    deliver(files.withColumn("head_sha", F.lit("later")), tmp_path)
    started(spark, tmp_path, files.schema)
    before = tables(spark, tmp_path)
    # A checkpoint without the last commit: the restarted query runs that batch again, over its written folders.
    commits = {p.name for p in (tmp_path / "state" / "commits").iterdir()}
    assert {"0", "1"} <= commits and "2" not in commits
    shutil.copytree(tmp_path / "state", tmp_path / "earlier", ignore=lambda d, names: [n for n in names if d.endswith("commits") and n in ("1", ".1.crc")])
    deliver(files, tmp_path)  # what arrives meanwhile was seen
    started(spark, tmp_path, files.schema, state="earlier")
    assert "1" in {p.name for p in (tmp_path / "earlier" / "commits").iterdir()}
    assert tables(spark, tmp_path) == before
    assert len(before[0]) == 2 * rv.analyze(files, load_rules()).count()


def test_versions_return_after_the_time(spark, tmp_path, files):
    out = str(tmp_path / "out")
    st.prepare(spark, out)
    at = lambda t: files.withColumns({"arrived": F.lit(t).cast("timestamp"), "source_file": F.lit(t), "source_row": F.col("file_ord")})
    for i, t in enumerate(("2026-01-01 10:00:00", "2026-01-01 10:59:00", "2026-01-01 11:01:00")):
        st.review_batch(at(t), i, load_rules(), out)
    n = {r.batch_id: r["count"] for r in spark.read.parquet(f"{out}/keys").groupBy("batch_id").count().collect()}
    assert n == {0: 8, 2: 8}


def test_no_text_is_shuffled(spark, tmp_path, files):
    """Keys and violations are: an exchange over the delivered rows has no content."""
    st.prepare(spark, str(tmp_path / "out"))
    f = files.withColumns({"arrived": F.lit("2026-01-01").cast("timestamp"), "source_file": F.lit("a"), "source_row": F.col("file_ord")})
    f.write.parquet(str(tmp_path / "in"))
    f = spark.read.parquet(str(tmp_path / "in"))
    fresh = st.new_versions(f, 0, str(tmp_path / "out"), "head_sha", "1 hour")
    assert "content" not in fresh.columns
    found = rv.analyze(f, load_rules(), [*st.FILE_KEY, *st.DELIVERY]).join(fresh.hint("merge").select(*st.DELIVERY), st.DELIVERY)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "Join Inner" in above and "content#" not in above


def test_log_of_a_range_of_days(spark, tmp_path):
    path = str(tmp_path / "log")
    src = spark.createDataFrame([("r", i, f"2026-03-{i:02d} 12:00:00") for i in range(1, 10)], "repo string, pr_number bigint, t string")
    write_review_log(event_rows(src, 1, "review_started", F.col("t").cast("timestamp"), {"pr": F.col("pr_number")}), path)
    some = read_review_log(spark, path, since="2026-03-03", until="2026-03-05")
    assert sorted(r.pr for r in some.collect()) == [3, 4, 5]
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "event_date" in filters and ">=" in filters and "<=" in filters
    assert read_review_log(spark, path).count() == 9


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_one_file_or_a_folder(spark, tmp_path, files):
    """The streamed documents are all of the table, however it is kept, and nothing that lies beside it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from pullscan.plans.registry import QUERIES

    def rows(a, b):
        return pa.table({"doc_id": pa.array(range(a, b), pa.int64()), "text": [f"password = 'x{i}'\nn = {i}" for i in range(a, b)]})

    at = tmp_path / "documents.parquet"
    if files == 1:
        pq.write_table(rows(0, 9), at)
    else:
        at.mkdir()
        for k in range(files):
            pq.write_table(rows(3 * k, 3 * k + 3), at / f"part-{k}.parquet")
    pq.write_table(rows(100, 109), tmp_path / "documents.parquet2")
    got = QUERIES["stream_review"](spark, str(tmp_path)).collect()
    want = QUERIES["analyze_documents"](spark, str(tmp_path)).collect()
    assert len(want) >= 9 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    events = QUERIES["stream_events"](spark, str(tmp_path)).groupBy("event").count().collect()
    assert {r["event"]: r["count"] for r in events}["rule_triggered"] == len(want)
