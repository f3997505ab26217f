"""One review of many pull requests, from exported tables to every output table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pullscan.model import FILE_KEY, PR_KEY
from pullscan.operators import answers as ans
from pullscan.operators import review as rv
from pullscan.operators.diff import added_chunks
from pullscan.operators.rewrite import apply_fixes, fix_lists, with_model_rewrites
from pullscan.operators.verify import verification_all, verification_results, verify
from pullscan.rules.config import RuleSet, load_rules
from pullscan.session import shared_path
from pullscan.sources.reviewlog import event_rows
from pullscan.sources.tables import latest_commit


@dataclass
class ReviewInputs:
    pull_requests: DataFrame
    file_changes: DataFrame
    file_contents: DataFrame
    commits: DataFrame | None = None
    model_answers: DataFrame | None = None
    generated_comments: DataFrame | None = None
    refactor_answers: DataFrame | None = None  # repo, pr_number, filename, response
    equivalence_answers: DataFrame | None = None  # repo, pr_number, filename, response
    tests: DataFrame | None = None  # repo, pr_number, passed, total_tests of the run on the rewritten files


@dataclass
class ReviewOptions:
    rules: RuleSet = field(default_factory=load_rules)
    enable_verification: bool = True
    enable_tests: bool = True
    enable_rollback: bool = True
    # Write tables that several outputs read to the shared folder and go on from there.
    materialize: bool = False


@dataclass
class Review:
    files: DataFrame
    violations: DataFrame
    comments: DataFrame
    decisions: DataFrame
    results: DataFrame
    verified: DataFrame
    route: DataFrame


def materialized(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, its lineage ends there, and losing
    executors does not lose it."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reviewed_files(inputs: ReviewInputs) -> DataFrame:
    """Gate first, then fetch: content is joined only for files that will be reviewed."""
    return rv.file_at_ref(
        rv.analyzable_files(inputs.file_changes), inputs.pull_requests, inputs.file_contents
    )


def files_to_fix(inputs: ReviewInputs, violations: DataFrame) -> DataFrame:
    """The files with enough findings for a rewrite, with their texts: keys first, so that patches stay behind and only the
    contents of these files are joined. ``violations`` is best a written table, as it is read once more for the keys."""
    wanted = fix_lists(violations).select(*PR_KEY, "filename")
    head = ["head_branch"] if "head_branch" in inputs.file_changes.columns else []
    gated = rv.analyzable_files(inputs.file_changes).select(*FILE_KEY, *head)
    return rv.file_at_ref(gated.join(wanted, [*PR_KEY, "filename"], "left_semi"), inputs.pull_requests, inputs.file_contents)


def all_violations(files: DataFrame, inputs: ReviewInputs, rules: RuleSet) -> DataFrame:
    """Static findings and, where answers are given, model findings."""
    found = rv.analyze(files, rules)
    if inputs.model_answers is not None:
        found = found.unionByName(ans.model_issues(added_chunks(files, FILE_KEY, 3), inputs.model_answers))
    return found


def review_route(
    decisions: DataFrame,
    results: DataFrame,
    verified: DataFrame,
    options: ReviewOptions,
    tests: DataFrame | None = None,
    commits: DataFrame | None = None,
) -> DataFrame:
    """Per pull request: was it refactored, verified, tested, rolled back, and are its rewrites reported."""
    ok = F.lit(True)
    rewrites = results.filter("success").groupBy(*PR_KEY).agg(F.count(F.lit(1)).alias("n_rewritten"))
    checks = verification_all(decisions, verification_results(verified))
    j = decisions.select(*PR_KEY, "should_delegate").join(rewrites, PR_KEY, "left").join(checks, PR_KEY, "left")
    j = (
        j.join(tests.select(*PR_KEY, F.col("passed").alias("t_passed"), F.col("total_tests").alias("t_total")), PR_KEY, "left")
        if tests is not None
        else j.withColumn("t_passed", F.lit(None).cast("int")).withColumn("t_total", F.lit(None).cast("int"))
    )
    j = (
        j.join(latest_commit(commits), PR_KEY, "left")
        if commits is not None
        else j.withColumn("sha", F.lit(None).cast("string"))
    )
    n = F.coalesce("n_rewritten", F.lit(0).cast("bigint"))
    refactor = F.col("should_delegate")
    verify_step = refactor & F.lit(options.enable_verification)
    verified_ok = F.when(verify_step & (n > 0), F.col("verification_passed")).otherwise(ok)
    test_step = verify_step & F.lit(options.enable_tests) & verified_ok
    tests_ok = F.when(
        test_step & (n > 0), F.coalesce(F.col("t_passed") == F.col("t_total"), ok)
    ).otherwise(ok)
    rollback = verify_step & F.lit(options.enable_rollback) & ~(verified_ok & tests_ok)
    performed = rollback & F.col("sha").isNotNull()
    return j.select(
        *PR_KEY,
        refactor.alias("refactor"),
        F.when(refactor, n).otherwise(F.lit(0).cast("bigint")).alias("n_rewritten"),
        verify_step.alias("verify"),
        verified_ok.alias("verification_passed"),
        test_step.alias("test"),
        tests_ok.alias("tests_passed"),
        rollback.alias("rollback"),
        performed.alias("rollback_performed"),
        (refactor & (n > 0) & ~performed).alias("refactoring_performed"),
        "sha",
    )


def mark_refactored(route: DataFrame, results: DataFrame) -> DataFrame:
    """The rewritten files a summary reports: those of pull requests that were refactored and not rolled back."""
    return (
        results.filter("success")
        .select(*PR_KEY, F.col("filename").alias("file"))
        .join(route.filter("refactoring_performed").select(*PR_KEY), PR_KEY, "left_semi")
    )


def review(spark: SparkSession, inputs: ReviewInputs, options: ReviewOptions | None = None) -> Review:
    """Build every table of a review. Nothing runs until an output is written, unless ``materialize`` is set."""
    options = options or ReviewOptions()
    files = reviewed_files(inputs)
    violations = all_violations(files, inputs, options.rules)
    if options.materialize:
        violations = materialized(violations, spark, "violations")
    decisions = rv.pr_decisions(
        inputs.pull_requests, inputs.file_changes, violations, options.rules.delegation
    )
    if options.materialize:
        decisions = materialized(decisions, spark, "decisions")
    comments = rv.review_comments(violations, inputs.generated_comments)
    wanted = decisions.filter("should_delegate").select(*PR_KEY)
    delegated = violations.join(wanted, PR_KEY, "left_semi")
    results = apply_fixes(files_to_fix(inputs, delegated) if options.materialize else files, delegated)
    if inputs.refactor_answers is not None:
        results = with_model_rewrites(results, delegated, inputs.refactor_answers)
    if options.materialize:
        results = materialized(results, spark, "results")
    pairs = results.filter("success").select(
        *FILE_KEY, F.col("original_code").alias("original"), F.col("refactored_code").alias("refactored")
    )
    told = inputs.equivalence_answers
    if told is not None:
        told = told.select(*PR_KEY, "filename", ans.parse_equivalence(F.col("response")).alias("parsed"))
        told = pairs.select(*FILE_KEY).join(told, [*PR_KEY, "filename"], "left").select(*FILE_KEY, "parsed")
    verified = verify(pairs, told)
    if options.materialize:
        verified = materialized(verified, spark, "verified")
    route = review_route(decisions, results, verified, options, inputs.tests, inputs.commits)
    if options.materialize:
        # Six of the events read it, and it holds the newest commits and tests of all pull requests.
        route = materialized(route, spark, "route")
    return Review(files, violations, comments, decisions, results, verified, route)


def comment_fields(body: Column) -> dict[str, Column]:
    c = F.col
    return {"file": c("file"), "line": c("line"), "severity": c("severity"), "rule_id": c("rule_id"),
            "body": body, "suggestion_code": c("suggestion_code")}


def static_events(
    headers: DataFrame, decisions: DataFrame, violations: DataFrame, comments: DataFrame, at: Column
) -> DataFrame:
    """The events of a review without rewrites: started, files fetched, each finding, each comment, completed."""
    c = F.col
    parts = [
        event_rows(headers, 1, "review_started", at, {"pr": c("pr_number")}),
        event_rows(decisions, 2, "pr_fetched", at, {"files_count": c("total_files")}),
        event_rows(violations, 4, "rule_triggered", at, {
            "rule_id": c("rule_id"), "file": c("file"), "line": c("line"), "severity": c("severity")}),
        event_rows(comments, 5, "comment_generated", at, comment_fields(c("body"))),
        event_rows(decisions, 13, "review_completed", at, {
            "total_violations": c("total_violations"), "comments_posted": c("total_violations")}),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def review_events(
    r: Review, inputs: ReviewInputs, at: Column | None = None, enable_rollback: bool = True
) -> DataFrame:
    """Every event of every review as JSON rows, ordered within a pull request by ``step`` and the order columns."""
    at = F.current_timestamp() if at is None else at
    prs = inputs.pull_requests
    none = F.lit(None)
    c = F.col
    results = r.results
    verification = verification_results(r.verified).join(
        r.route.filter("verify").select(*PR_KEY), PR_KEY, "left_semi"
    )
    tested = r.route.filter(c("test") & (c("n_rewritten") > 0))
    if inputs.tests is not None:
        tested = tested.join(inputs.tests.select(*PR_KEY, "passed", "total_tests"), PR_KEY)
    else:
        tested = tested.withColumn("passed", none.cast("int")).withColumn("total_tests", none.cast("int")).filter(F.lit(False))
    # A row per file: the list of a pull request's files has no bound.
    rolled = results.filter("success").join(r.route.filter("rollback_performed").select(*PR_KEY), PR_KEY, "left_semi")
    with_sha = r.route.filter(c("sha").isNotNull() & F.lit(enable_rollback))
    parts = [
        static_events(prs, r.decisions, r.violations, r.comments, at),
        event_rows(with_sha, 3, "rollback_point_created", at, {"sha": F.substring("sha", 1, 7), "full_sha": c("sha")}),
        event_rows(r.route.filter("refactor"), 6, "delegation", at, {"target": F.lit("refactor_agent")}),
        event_rows(results.filter("success"), 7, "refactor_applied", at, {"file": c("filename")}),
        event_rows(verification, 8, "verification", at, {"file": c("filename"), "passed": c("passed")}),
        event_rows(tested, 9, "tests", at, {"passed": c("passed"), "total": c("total_tests")}),
        event_rows(rolled, 10, "rollback", at, {"success": F.lit(True), "file": c("filename")}),
        event_rows(r.comments, 11, "comment_post_attempt", at, comment_fields(c("body"))),
        event_rows(r.decisions, 12, "comments_posted", at, {"count": c("total_violations"), "success": F.lit(True)}),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def error_events(failures: DataFrame, event: str, at: Column) -> DataFrame:
    """``error``, ``refactor_failed``, ``tests_error`` and ``rollback_failed`` events from a table of failures
    (``repo, pr_number, message`` and optionally ``filename``), for jobs that collect failures of outside calls."""
    field_name = "message" if event == "error" else "error"
    fields = {"file": F.col("filename")} if "filename" in failures.columns else {}
    return event_rows(failures, 14, event, at, {**fields, field_name: F.col("message")})
