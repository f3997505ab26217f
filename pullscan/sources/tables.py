"""Scans of exported review tables, and the plan tables that replace write calls to a code host."""

from __future__ import annotations

import glob as globbing
import re
from functools import partial

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pullscan import model
from pullscan.model import PR_KEY
from pullscan.operators.review import file_at_ref
from pullscan.operators.rewrite import commit_message
from pullscan.sources import filewriter


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Read an exported table. The schema is given, so nothing is inferred and only needed columns are read."""
    return spark.read.schema(schema).format(fmt).load(path)


def scan_pull_requests(source: DataFrame) -> DataFrame:
    """Pull request headers; a null body becomes empty text."""
    return source.withColumn("body", F.coalesce("body", F.lit("")))


def read_pull_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return scan_pull_requests(read(spark, path, model.PULL_REQUESTS, fmt))


def read_file_changes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return scan_file_changes(read(spark, path, model.FILE_CHANGES, fmt))


def read_file_contents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, model.FILE_CONTENTS, fmt)


def scan_file_changes(source: DataFrame) -> DataFrame:
    """One row per changed file, with whether it was removed."""
    return source.withColumn("is_deleted", F.col("status") == "removed")


def files_of_pull_requests(nested: DataFrame) -> DataFrame:
    """The same table from pull requests exported with a ``files`` array."""
    return nested.select(*PR_KEY, F.posexplode("files").alias("file_ord", "f")).select(
        *PR_KEY, F.col("file_ord").cast("bigint").alias("file_ord"),
        *[F.col(f"f.{c}").alias(c) for c in ("filename", "status", "additions", "deletions", "patch")],
    )


#: Folders of written files; each is listed by itself, and written by one task.
FOLDERS = 256
#: Where ``write_files`` puts its folders, below its path.
WRITTEN = "folder=*"
# The helper travels with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(filewriter)


def _local(path: str) -> str | None:
    """The path of a folder of a local file system, else None."""
    return "/" + re.sub(r"^(file:)?/+", "", path.rstrip("/")) if re.match(r"(file:)?/", path) else None


def write_files(texts: DataFrame, path: str) -> None:
    """One file per row of ``name, text`` in a folder ``folder=<number>/name=<name>`` below ``path``; a line feed ends the file.

    Rows of one name are in one file. Spark's writer asks a local file system for the rights of each file and folder in a process of
    its own, and renames all folders from the driver; so files of a local folder are written by the tasks themselves.
    """
    folder = F.pmod(F.xxhash64("name"), F.lit(FOLDERS)).alias("folder")
    dealt = texts.select(folder, "name", F.col("text").alias("value")).repartition(FOLDERS, "folder")
    # A folder to be found where there is no row.
    texts.limit(0).select("text").write.text(f"{path.rstrip('/')}/folder=none")
    root = _local(path)
    if root is None:
        dealt.write.mode("append").partitionBy("folder", "name").text(path)
        return
    sorted_ = dealt.sortWithinPartitions("folder", "name")
    sorted_.mapInArrow(partial(filewriter.written, root), "n BIGINT").write.format("noop").mode("overwrite").save()


def file_contents_from_files(
    spark: SparkSession, path: str, repo: str, ref: str, glob: str | None = None, below: str | None = None
) -> DataFrame:
    """File texts below a checked-out folder. ``path`` is relative to the folder; ``glob`` picks files by their names.

    ``below`` names, as a pattern, the folders in it to be read. On a local file system each is listed and read by a task of its own;
    elsewhere, and without ``below``, Spark's file index holds an entry for each file in the driver.

    The text is UTF-8 with U+FFFD for what is none; ``sha`` is of the bytes as they are.
    """
    root = path.rstrip("/") + "/"
    found = _contents_by_folder(spark, path, glob, below) if below else None
    if found is None:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        relative = F.substring_index(F.col("path"), root, -1)
        found = reader.load(root + below if below else path).select(relative.alias("path"), "content")
    return found.select(
        F.lit(repo).alias("repo"), "path", F.lit(ref).alias("ref"),
        F.sha1("content").alias("sha"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def _contents_by_folder(spark: SparkSession, path: str, glob: str | None, below: str) -> DataFrame | None:
    """``path, content`` of the files in some folders, a task for each; None where there is none, the file system is not local, or a
    pattern has more than ``*`` and ``?``."""
    root = _local(path)
    if root is None or re.search(r"[][{}*?\\]", path) or re.search(r"[][{}\\]", below + (glob or "")):
        return None
    folders = sorted(globbing.glob(f"{root}/{below}", include_hidden=True))
    if not folders:
        return None
    read_ = partial(filewriter.contents_of, f"{root}/", folders, glob)
    return spark.range(0, len(folders), 1, len(folders)).mapInArrow(read_, "path STRING, content BINARY")


# ---------------------------------------------------------------------------------------------------------
# commits and rollback


def latest_commit(commits: DataFrame) -> DataFrame:
    return commits.groupBy(*PR_KEY).agg(F.max_by("sha", "commit_ord").alias("sha"))


def commit_plan(results: DataFrame, pull_requests: DataFrame, file_contents: DataFrame) -> DataFrame:
    """Per successful rewrite: update the file where the branch has it, else create it. The message names three rules, as a
    title does; ``violations_fixed`` has all of them."""
    heads = pull_requests.select(*PR_KEY, F.col("head_branch").alias("ref"))
    existing = file_contents.select("repo", F.col("path").alias("filename"), "ref", F.col("sha").alias("existing_sha"))
    return (
        results.filter("success")
        .join(heads, PR_KEY)
        .join(existing, ["repo", "filename", "ref"], "left")
        .select(
            *PR_KEY, "filename", F.col("ref").alias("branch"),
            F.when(F.col("existing_sha").isNotNull(), "update").otherwise("create").alias("action"),
            "existing_sha", commit_message(F.col("violations_fixed")).alias("message"),
            "violations_fixed", F.col("refactored_code").alias("content"),
        )
    )


def rollback_plan(
    rewritten: DataFrame, rollback_refs: DataFrame, pull_requests: DataFrame, file_contents: DataFrame
) -> DataFrame:
    """Per rewritten file: its text at the rollback commit. Files missing at either side are left out.

    ``rollback_refs``: ``repo, pr_number, sha, ref`` where ``ref`` names the commit in ``file_contents``. The message has
    the short form of the commit, ``rollback_sha`` the whole one.
    """
    text = file_contents.select("repo", F.col("path").alias("filename"), "ref", "content")
    now = file_contents.select(
        "repo", F.col("path").alias("filename"), F.col("ref").alias("branch"), F.col("sha").alias("current_sha")
    )
    heads = pull_requests.select(*PR_KEY, F.col("head_branch").alias("branch"))
    return (
        rewritten.select(*PR_KEY, "filename")
        .join(rollback_refs, PR_KEY)
        .join(heads, PR_KEY)
        .join(text, ["repo", "filename", "ref"])
        .join(now, ["repo", "filename", "branch"])
        .select(
            *PR_KEY, "filename", "branch", "current_sha", "content", F.col("sha").alias("rollback_sha"),
            F.concat(F.lit("Rollback: Revert "), F.col("filename"), F.lit(" to "), F.substring("sha", 1, 7)).alias(
                "message"
            ),
        )
    )


def last_rollback_point(points: Column) -> Column:
    """The most recent saved commit, null when there is none."""
    return F.try_element_at(points, F.lit(-1))


def rollback_points(saved: DataFrame) -> DataFrame:
    """Saved commits as numbered rows with the last one marked; ``saved``: ``repo, pr_number, saved_ord, sha``.

    A maximum per pull request and a join replace an ordered list, so a pull request with very many points is never
    gathered in one place.
    """
    last = saved.groupBy(*PR_KEY).agg(
        F.max("saved_ord").alias("last_ord"), F.count(F.lit(1)).alias("n_points"),
        F.max_by("sha", "saved_ord").alias("last_sha"),
    )
    return last.select(*PR_KEY, "n_points", "last_ord", "last_sha")


def numbered_rollback_points(saved: DataFrame) -> DataFrame:
    """Every saved commit as a row in its order, the last one marked: ``repo, pr_number, saved_ord, sha, is_last``.

    ``saved_ord`` is the number; no list or window gathers a pull request.
    """
    last = saved.groupBy(*PR_KEY).agg(F.max("saved_ord").alias("last_ord"))
    return saved.join(last, PR_KEY).select(*PR_KEY, "saved_ord", "sha", (F.col("saved_ord") == F.col("last_ord")).alias("is_last"))


# ---------------------------------------------------------------------------------------------------------
# handoff context


def handoff_chain_entry(role: Column, at: Column) -> Column:
    return F.concat_ws("@", role, at)


def handoff_maps(files: DataFrame) -> DataFrame:
    """Path and text of every file that is not removed and not empty: the entries of the path-to-text map as rows,
    one per file, so the texts of a large pull request are never put into one row."""
    return files.filter((F.col("status") != "removed") & (F.length("content") > 0)).select(
        *PR_KEY, F.col("filename").alias("path"), "content"
    )


#: Written into every record; records of an earlier version lack the key.
SNAPSHOT_VERSION = 2
SNAPSHOT_FILE = (
    "version INT, pr_number BIGINT, repository STRING, branch STRING, file STRING, violations ARRAY<STRING>, "
    "original_code STRING, refactored_code STRING, started_at STRING, handoff_chain ARRAY<STRING>"
)
SNAPSHOT_COMMIT = "version INT, pr_number BIGINT, repository STRING, kind STRING, ord BIGINT, sha STRING"
#: Kinds of commit records: what the context lists as made, and as points to return to.
COMMITS_MADE, ROLLBACK_POINTS = "commits_made", "rollback_points"


def handoff_snapshot(
    changes: DataFrame, pull_requests: DataFrame, file_contents: DataFrame, results: DataFrame, violations: DataFrame, at: Column
) -> DataFrame:
    """The context as JSON, one record per file of a pull request with that file's violations and texts.

    What is known by pull request and by name is put together first; the texts on the head branch join last, and are moved by no other key.
    """
    rewritten = results.filter("success").select(*PR_KEY, "filename", "refactored_code")
    heads = pull_requests.select(*PR_KEY, F.col("head_branch").alias("branch"))
    item = F.struct("rule_ord", "line", "seq", F.to_json(F.struct(*model.VIOLATION_COLUMNS)).alias("json"))
    found = (
        violations.groupBy(*PR_KEY, F.col("file").alias("filename"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select(*PR_KEY, "filename", F.transform("items", lambda x: x["json"]).alias("violations"))
    )
    record = F.struct(
        F.lit(SNAPSHOT_VERSION).alias("version"),
        F.col("pr_number"),
        F.col("repo").alias("repository"),
        F.col("branch"),
        F.col("filename").alias("file"),
        F.col("violations"),
        F.when((F.col("status") != "removed") & (F.length("content") > 0), F.col("content")).alias("original_code"),
        F.col("refactored_code"),
        at.alias("started_at"),
        F.array(handoff_chain_entry(F.lit("orchestrator"), at)).alias("handoff_chain"),
    )
    known = (
        changes.select(*model.FILE_KEY, "status", *(c for c in ("head_branch",) if c in changes.columns))
        .join(heads, PR_KEY)
        .join(found, [*PR_KEY, "filename"], "left")
        .join(rewritten, [*PR_KEY, "filename"], "left")
    )
    return file_at_ref(known, pull_requests, file_contents).select(*PR_KEY, "file_ord", F.to_json(record).alias("value"))


def restore_snapshot(snapshot: DataFrame, now: Column) -> DataFrame:
    """Read snapshot records back; missing keys get their defaults, a missing version is the first one."""
    strings = F.array().cast("array<string>")
    return snapshot.select(F.from_json("value", SNAPSHOT_FILE).alias("c")).select(
        F.col("c.repository").alias("repo"), "c.pr_number", "c.branch", F.col("c.file").alias("filename"),
        "c.original_code", "c.refactored_code",
        *[F.coalesce(f"c.{k}", strings).alias(k) for k in ("violations", "handoff_chain")],
        F.coalesce("c.started_at", now).alias("started_at"), F.coalesce("c.version", F.lit(1)).alias("version"),
    )


def snapshot_commits(made: DataFrame, points: DataFrame) -> DataFrame:
    """The context's commits and rollback points as JSON, one record each: a list of them has no bound, and would stand
    in the record of every file. Both tables: ``repo, pr_number, commit_ord, sha``."""

    def records(commits: DataFrame, kind: str) -> DataFrame:
        record = F.struct(
            F.lit(SNAPSHOT_VERSION).alias("version"), F.col("pr_number"), F.col("repo").alias("repository"),
            F.lit(kind).alias("kind"), F.col("commit_ord").cast("bigint").alias("ord"), F.col("sha"),
        )
        return commits.select(*PR_KEY, F.to_json(record).alias("value"))

    return records(made, COMMITS_MADE).unionByName(records(points, ROLLBACK_POINTS))


#: Records of a file of commit records; a packed one is read by one task.
RECORDS_OF_A_FILE = 500_000


def write_snapshot_commits(records: DataFrame, path: str) -> None:
    """The records as packed JSON lines: most of a record are the names of its fields."""
    records.select("value").write.option("maxRecordsPerFile", RECORDS_OF_A_FILE).option("compression", "gzip").text(path)


def restore_snapshot_commits(records: DataFrame) -> DataFrame:
    """``repo, pr_number, kind, ord, sha, version``; a record without a kind lists a commit made."""
    return records.select(F.from_json("value", SNAPSHOT_COMMIT).alias("c")).select(
        F.col("c.repository").alias("repo"), "c.pr_number", F.coalesce("c.kind", F.lit(COMMITS_MADE)).alias("kind"),
        F.coalesce("c.ord", F.lit(0).cast("bigint")).alias("ord"), "c.sha", F.coalesce("c.version", F.lit(1)).alias("version"),
    )


def with_commit_counts(restored: DataFrame, commits: DataFrame) -> DataFrame:
    """Restored files with ``n_commits`` and ``n_rollback_points`` of their pull request, and its last point."""
    of = lambda kind: F.col("kind") == kind
    counts = commits.groupBy(*PR_KEY).agg(
        F.count_if(of(COMMITS_MADE)).alias("n_commits"), F.count_if(of(ROLLBACK_POINTS)).alias("n_rollback_points"),
        F.max_by(F.when(of(ROLLBACK_POINTS), F.col("sha")), F.when(of(ROLLBACK_POINTS), F.col("ord"))).alias("last_point"),
    )
    zero = F.lit(0).cast("bigint")
    return restored.join(counts, PR_KEY, "left").withColumns({c: F.coalesce(c, zero) for c in ("n_commits", "n_rollback_points")})
