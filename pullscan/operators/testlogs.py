"""Test logs and test selection as tables. Nothing is executed; logs are parsed and paths are joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.functions import text as tx
from pullscan.model import PR_KEY

# Summary formats of the two test tools.
_THREE = r"(?iUd)(\d+) passed.*?(\d+) failed.*?(\d+) error"
_PASSED = r"(?Ud)(\d+) passed"
_FAILED = r"(?Ud)(\d+) failed"
_DURATION = r"(?Ud)in ([\d.]+)s"
_COVERAGE = r"(?Ud)TOTAL\s+\d+\s+\d+\s+(\d+)%"
_ONE_TEST = rf"(?Ud)([\p{{L}}\p{{N}}_/\.]+::{tx.WORD}+){tx.WS}+(PASSED|FAILED|ERROR|SKIPPED)"
_UNITTEST_OK = r"(?Ud)OK \(tests=(\d+)\)"
_UNITTEST_FAILED = r"(?Ud)FAILED \(.*?failures=(\d+)"
EXCLUDED_DIRECTORIES = (".venv", "venv", "node_modules", ".git")
PYTEST_MARKERS = ("pytest", "conftest.py", "pytest.ini", "pyproject.toml")


def _group(col: Column, pattern: str, i: int = 1) -> Column:
    """The group's text, null when the pattern is not found."""
    return F.nullif(F.regexp_extract(col, pattern, i), F.lit(""))


def _int(col: Column) -> Column:
    return F.coalesce(col.cast("int"), F.lit(0))


def success_rate(passed: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(passed / total)


def _heard(logs: DataFrame, tool: str) -> DataFrame:
    """The runs of a tool. What a timed-out run printed before is not read."""
    late = F.coalesce(F.col("timed_out"), F.lit(False))
    return logs.filter(F.col("tool") == tool).withColumns({c: F.when(~late, F.col(c)) for c in ("stdout", "stderr") if c in logs.columns})


def _suite(logs: DataFrame, keys: list[str], passed, failed, errors, duration, coverage) -> DataFrame:
    counted = logs.select(
        *keys,
        # A timed-out run has no output to read.
        F.when(F.col("timed_out"), "error")
        .when(F.col("returncode") == 0, "passed")
        .otherwise("failed")
        .alias("status"),
        passed.alias("passed"),
        failed.alias("failed"),
        errors.alias("errors"),
        F.lit(0).alias("skipped"),
        duration.alias("duration_ms"),
        coverage.alias("coverage_percent"),
    )
    total = F.col("passed") + F.col("failed") + F.col("errors")
    return counted.withColumn("total_tests", total).withColumn(
        "success_rate", success_rate(F.col("passed"), F.col("total_tests"))
    )


def pytest_suites(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, duration and coverage from stdout. The three-count line needs the order passed, failed, error;
    otherwise passed and failed are read singly and errors stay 0."""
    out = F.col("stdout")
    three = out.rlike(_THREE)
    pick = lambda i, single: _int(F.when(three, _group(out, _THREE, i)).otherwise(single))
    return _suite(
        _heard(logs, "pytest"),
        keys,
        pick(1, _group(out, _PASSED)),
        pick(2, _group(out, _FAILED)),
        pick(3, F.lit(None).cast("string")),
        F.coalesce(_group(out, _DURATION).try_cast("double") * 1000, F.lit(0.0)),
        _group(out, _COVERAGE).cast("double"),
    )


def pytest_results(logs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per test named in the output."""
    names = F.regexp_extract_all("stdout", F.lit(_ONE_TEST), F.lit(1))
    statuses = F.regexp_extract_all("stdout", F.lit(_ONE_TEST), F.lit(2))
    zipped = F.arrays_zip(names.alias("name"), statuses.alias("status"))
    return (
        _heard(logs, "pytest")
        .select(*keys, F.posexplode(zipped).alias("test_no", "t"))
        .select(*keys, "test_no", F.col("t.name").alias("name"), F.lower("t.status").alias("status"))
    )


def unittest_suites(logs: DataFrame, keys: list[str]) -> DataFrame:
    err = F.col("stderr")
    return _suite(
        _heard(logs, "unittest"),
        keys,
        _int(_group(err, _UNITTEST_OK)),
        _int(_group(err, _UNITTEST_FAILED)),
        F.lit(0),
        F.lit(0.0),
        F.lit(None).cast("double"),
    )


def suites(logs: DataFrame, keys: list[str]) -> DataFrame:
    return pytest_suites(logs, keys).unionByName(unittest_suites(logs, keys))


def tests_passed(suite_rows: DataFrame, keys: list[str]) -> DataFrame:
    """``passed == total_tests``: an empty or timed-out run counts as passed, so the status is kept next to it."""
    return suite_rows.select(
        *keys, "status", "passed", "total_tests", (F.col("passed") == F.col("total_tests")).alias("tests_passed")
    )


# ---------------------------------------------------------------------------------------------------------
# which tests to run


def _base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def discover_tests(tree: DataFrame) -> DataFrame:
    """``test_*.py`` and ``*_test.py`` outside excluded directories; a name that fits both is listed for each."""
    path = F.col("path")
    base = _base_name(path)
    excluded = reduce(lambda a, b: a | b, [path.contains(x) for x in EXCLUDED_DIRECTORIES])
    fits = F.array_compact(
        F.array(
            F.when(base.rlike(r"(?ds)^test_.*\.py$"), "test_*.py"),
            F.when(base.rlike(r"(?ds)^.*_test\.py$"), "*_test.py"),
        )
    )
    return tree.filter(~excluded).select("repo", "path", F.explode(fits).alias("pattern"))


def repo_wide_tests(tree: DataFrame) -> DataFrame:
    """Every ``test_*.py`` below ``tests/``: related to any change in the repository."""
    path = F.col("path")
    return tree.filter(
        path.startswith("tests/") & _base_name(path).rlike(r"(?ds)^test_.*\.py$")
    ).select("repo", "path").distinct()


def related_tests(changed: DataFrame, tree: DataFrame) -> DataFrame:
    """Tests related to changed source files.

    Rows with a ``pr_number`` come from the four name patterns. Rows without one hold for every pull request of the
    repository; keeping them once per repository avoids repeating all tests for each pull request.
    """
    stem, parent = tx.path_stem(F.col("filename")), tx.path_parent(F.col("filename"))
    candidates = F.array(
        F.concat(F.lit("test_"), stem, F.lit(".py")),
        F.concat(stem, F.lit("_test.py")),
        F.concat(F.lit("tests/test_"), stem, F.lit(".py")),
        F.concat(F.lit("tests/"), parent, F.lit("/test_"), stem, F.lit(".py")),
    )
    wanted = changed.select(*PR_KEY, F.explode(candidates).alias("listed")).select(
        *PR_KEY, "listed", F.regexp_replace("listed", r"/\./", "/").alias("path")
    )
    specific = wanted.join(tree.select("repo", "path"), ["repo", "path"], "left_semi").select(
        *PR_KEY, F.col("listed").alias("path")
    )
    wide = repo_wide_tests(tree)
    # Already covered by the repository-wide rows.
    own = specific.join(wide, ["repo", "path"], "left_anti").distinct()
    return own.unionByName(wide.select("repo", F.lit(None).cast("bigint").alias("pr_number"), "path"))


def detect_framework(tree: DataFrame, requirements: DataFrame | None = None) -> DataFrame:
    """Marker files per repository. The framework is pytest either way, the markers say why.

    ``requirements``: optional ``repo, content`` of ``requirements.txt``.
    """
    marks = tree.groupBy("repo").agg(
        F.bool_or(F.col("path").isin(*PYTEST_MARKERS)).alias("has_marker_file"),
        F.bool_or(F.col("path") == "requirements.txt").alias("has_requirements"),
    )
    if requirements is not None:
        named = requirements.groupBy("repo").agg(
            F.bool_or(F.lower("content").contains("pytest")).alias("requirements_name_pytest")
        )
        marks = marks.join(named, "repo", "left")
    return marks.withColumn("framework", F.lit("pytest"))


def tests_to_run(pull_requests: DataFrame, changed: DataFrame, tree: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Per pull request where its tests come from (``given``, ``related``, ``discovered``, ``none``) and how many.

    Counts are joined, not lists, so a repository's tests are never repeated per pull request.
    """
    related = related_tests(changed, tree)
    own = related.filter(F.col("pr_number").isNotNull()).groupBy(*PR_KEY).agg(F.count(F.lit(1)).alias("n_own"))
    wide = related.filter(F.col("pr_number").isNull()).groupBy("repo").agg(F.count(F.lit(1)).alias("n_wide"))
    found = discover_tests(tree).groupBy("repo").agg(F.count(F.lit(1)).alias("n_found"))
    has_changes = changed.select(*PR_KEY).distinct().withColumn("has_changes", F.lit(True))
    zero = F.lit(0).cast("bigint")
    j = pull_requests.select(*PR_KEY)
    j = j.join(has_changes, PR_KEY, "left").join(own, PR_KEY, "left").join(wide, "repo", "left").join(found, "repo", "left")
    if given is not None:
        j = j.join(given.groupBy(*PR_KEY).agg(F.count(F.lit(1)).alias("n_given")), PR_KEY, "left")
    else:
        j = j.withColumn("n_given", zero)
    n_related = F.when(F.col("has_changes"), F.coalesce("n_own", zero) + F.coalesce("n_wide", zero)).otherwise(zero)
    j = j.select(*PR_KEY, F.coalesce("n_given", zero).alias("g"), n_related.alias("r"), F.coalesce("n_found", zero).alias("d"))
    pick = lambda g, r, d, none: (
        F.when(F.col("g") > 0, g).when(F.col("r") > 0, r).when(F.col("d") > 0, d).otherwise(none)
    )
    return j.select(
        *PR_KEY,
        pick(F.lit("given"), F.lit("related"), F.lit("discovered"), F.lit("none")).alias("source"),
        pick(F.col("g"), F.col("r"), F.col("d"), zero).alias("n_tests"),
        F.when(pick(F.col("g"), F.col("r"), F.col("d"), zero) == 0, "no_tests").alias("status"),
    )


def test_list(pull_requests: DataFrame, changed: DataFrame, tree: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """The tests to run as rows: ``repo, pr_number, source, path``.

    A row without a ``pr_number`` holds for every pull request of its repository that ``tests_to_run`` gives this ``source``,
    so that a repository's tests are listed once and not for each pull request.
    """
    key = [*PR_KEY, "source"]
    chosen = tests_to_run(pull_requests, changed, tree, given).select(*key)
    related = related_tests(changed, tree).withColumn("source", F.lit("related"))
    own = related.filter(F.col("pr_number").isNotNull())
    if given is not None:
        own = own.unionByName(given.select(*PR_KEY, "path").withColumn("source", F.lit("given")))
    wide = related.filter(F.col("pr_number").isNull())
    wide = wide.unionByName(
        discover_tests(tree).select("repo", F.lit(None).cast("bigint").alias("pr_number"), "path", F.lit("discovered").alias("source"))
    )
    used = chosen.select("repo", "source").distinct()
    return own.join(chosen, key, "left_semi").select(*key, "path").unionByName(
        wide.join(used, ["repo", "source"], "left_semi").select(*key, "path")
    )
