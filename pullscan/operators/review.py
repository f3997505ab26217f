"""Static analysis and what is rolled up from violations: summaries, decisions, comments, payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.functions import text as tx
from pullscan.model import FILE_KEY, PR_KEY, SKIP_SUBSTRINGS, SUPPORTED_EXTENSIONS, VIOLATION_COLUMNS
from pullscan.operators.lines import review_units
from pullscan.rules.checks import CHECKS
from pullscan.rules.config import Delegation, RuleSet


# ---------------------------------------------------------------------------------------------------------
# files


def is_deleted(status: Column) -> Column:
    return status == "removed"


def is_added(change_type: Column) -> Column:
    return change_type == "added"


def should_analyze(filename: Column, status: Column, patch: Column) -> Column:
    """The file gate: not removed, has a patch, no skip substring, known extension or no dot at all."""
    skip = reduce(lambda a, b: a | b, [filename.contains(s) for s in SKIP_SUBSTRINGS])
    ext = tx.file_extension(filename)
    return (
        ~is_deleted(status)
        & F.coalesce(F.length(patch) > 0, F.lit(False))
        & ~skip
        & ((ext == "") | ext.isin(*SUPPORTED_EXTENSIONS))
    )


def analyzable_files(file_changes: DataFrame) -> DataFrame:
    return file_changes.filter(should_analyze(F.col("filename"), F.col("status"), F.col("patch")))


def with_head(file_changes: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """Changed files with ``ref``, the branch their text is read from: their own ``head_branch`` where they carry it, so
    that no patch is moved to find it, else that of their pull request."""
    if "head_branch" in file_changes.columns:
        return file_changes.withColumnRenamed("head_branch", "ref")
    return file_changes.join(pull_requests.select(*PR_KEY, F.col("head_branch").alias("ref")), PR_KEY)


def file_at_ref(file_changes: DataFrame, pull_requests: DataFrame, file_contents: DataFrame) -> DataFrame:
    """Each changed file with its text on the head branch; a missing file has null content.

    An equi join with the content table, by far the largest; bucketed on ``(repo, path, ref)`` (``sources.contents``) it
    stays where it is.
    """
    contents = file_contents.select("repo", F.col("path").alias("filename"), "ref", "content")
    return with_head(file_changes, pull_requests).join(contents, ["repo", "filename", "ref"], "left")


# ---------------------------------------------------------------------------------------------------------
# rules


def analyze(files: DataFrame, rules: RuleSet, keys: list[str] = FILE_KEY, with_text: bool = False) -> DataFrame:
    """All enabled rules over all files: scan to violations without a shuffle.

    ``files`` has the key columns, ``content`` and optionally ``patch``. Works on batch and streaming frames. ``with_text`` adds
    ``line_text``, the whole line of a finding, where a snippet may be shortened (null for findings about functions).
    """
    checks = [(i, r, c) for i, r in enumerate(rules.rules) for c in CHECKS[r.name](r)]
    kinds = {c.unit for _, _, c in checks}
    units = review_units(files, keys, lines="line" in kinds, functions="function" in kinds)

    def hit(c):
        return (F.col("unit") == c.unit) & F.coalesce(c.when, F.lit(False))

    found = F.array_compact(
        F.array(
            *[
                F.when(
                    hit(c),
                    F.struct(
                        F.lit(i).alias("rule_ord"),
                        F.lit(c.seq).alias("seq"),
                        F.lit(r.rule_id).alias("rule_id"),
                        F.lit(r.name).alias("rule_name"),
                        F.lit(r.category).alias("category"),
                        F.lit(r.severity).alias("severity"),
                        F.col("filename").alias("file"),
                        F.col("line").alias("line"),
                        F.lit(0).alias("column"),
                        c.message.alias("message"),
                        c.suggestion.alias("suggestion"),
                        c.snippet.alias("code_snippet"),
                        F.lit(float(c.confidence)).alias("confidence"),
                    ),
                )
                for i, r, c in checks
            ]
        )
    )
    # Few units violate anything: test the conditions in a compiled filter first, build rows only for hits.
    any_hit = reduce(lambda a, b: a | b, [hit(c) for _, _, c in checks])
    carried = [k for k in keys if k != "filename"]
    text = [F.col("text").alias("line_text")] if with_text else []
    return units.filter(any_hit).select(*carried, *text, F.inline(found))


def violation_order() -> list[Column]:
    """Report order: file, rule, line, then function before class."""
    return [F.col("file_ord"), F.col("rule_ord"), F.col("line"), F.col("seq")]


def violations_json(violations: DataFrame) -> DataFrame:
    """One JSON object with the 11 violation fields per row."""
    order = [c for c in ("repo", "pr_number", "file_ord", "rule_ord", "seq", "line") if c in violations.columns]
    return violations.select(*order, F.to_json(F.struct(*VIOLATION_COLUMNS)).alias("violation_json"))


# ---------------------------------------------------------------------------------------------------------
# roll-ups


def violations_per_file(violations: DataFrame) -> DataFrame:
    """Counts per file, combined map-side; a pull request with very many files stays spread over tasks."""
    severity = F.col("severity")
    return violations.groupBy(*PR_KEY, "file").agg(
        F.count(F.lit(1)).alias("n_violations"),
        F.count_if(severity == "critical").alias("critical_count"),
        F.count_if(severity == "error").alias("error_count"),
        F.count_if(severity == "warning").alias("warning_count"),
        F.count_if(severity == "info").alias("info_count"),
        F.count_if(F.col("rule_id") == "Q001").alias("complexity_count"),
        F.count_if(F.col("rule_id") != "LLM001").alias("static_count"),
    )


def files_with_issues(violations: DataFrame) -> DataFrame:
    """Distinct files with static findings; model findings do not count here."""
    return violations.filter(F.col("rule_id") != "LLM001").select(*PR_KEY, "file").distinct()


def distinct_files(violations: DataFrame) -> DataFrame:
    return violations.select(*PR_KEY, "file").distinct()


def fixable_files(violations: DataFrame, min_violations: int = 2) -> DataFrame:
    return (
        violations.groupBy(*PR_KEY, "file")
        .agg(F.count(F.lit(1)).alias("n_violations"))
        .filter(F.col("n_violations") >= min_violations)
    )


def violations_of_file(violations: DataFrame, results: DataFrame) -> DataFrame:
    """The violations of files that have a rewrite result."""
    return violations.join(results.select(*PR_KEY, F.col("filename").alias("file")), [*PR_KEY, "file"], "left_semi")


def pr_totals(pull_requests: DataFrame, file_changes: DataFrame) -> DataFrame:
    totals = file_changes.groupBy(*PR_KEY).agg(
        F.sum(F.col("additions").cast("bigint")).alias("total_additions"),
        F.sum(F.col("deletions").cast("bigint")).alias("total_deletions"),
        F.count(F.lit(1)).alias("total_files"),
    )
    zero = F.lit(0).cast("bigint")
    return pull_requests.select(*PR_KEY).join(totals, PR_KEY, "left").select(
        *PR_KEY,
        *[F.coalesce(c, zero).alias(c) for c in ("total_additions", "total_deletions", "total_files")],
    )


def _per_pr(violations: DataFrame, threshold: int) -> DataFrame:
    """Two-level roll-up: file counts first, then pull requests, both with partial aggregation."""
    return (
        violations_per_file(violations)
        .groupBy(*PR_KEY)
        .agg(
            F.sum("n_violations").alias("total_violations"),
            F.sum("critical_count").alias("critical_count"),
            F.sum("error_count").alias("error_count"),
            F.sum("warning_count").alias("warning_count"),
            F.sum("info_count").alias("info_count"),
            F.count_if(F.col("static_count") > 0).alias("files_with_issues"),
            F.bool_or(F.col("n_violations") >= threshold).alias("has_crowded_file"),
            F.bool_or(F.col("complexity_count") > 0).alias("has_complexity"),
        )
    )


def pr_decisions(
    pull_requests: DataFrame, file_changes: DataFrame, violations: DataFrame, delegation: Delegation = Delegation()
) -> DataFrame:
    """One row per pull request, also those without files or findings: counts and every decision drawn from them."""
    zero = F.lit(0).cast("bigint")
    files = file_changes.groupBy(*PR_KEY).agg(F.count(F.lit(1)).alias("total_files"))
    found = _per_pr(violations, delegation.violations_per_file_threshold)
    counts = ["total_files", "total_violations", "critical_count", "error_count", "warning_count", "info_count",
              "files_with_issues"]
    joined = pull_requests.select(*PR_KEY).join(files, PR_KEY, "left").join(found, PR_KEY, "left").select(
        *PR_KEY,
        *[F.coalesce(c, zero).alias(c) for c in counts],
        F.coalesce("has_crowded_file", F.lit(False)).alias("has_crowded_file"),
        F.coalesce("has_complexity", F.lit(False)).alias("has_complexity"),
    )
    blocking = (F.col("critical_count") > 0) | (F.col("error_count") > 0)
    delegate = F.col("has_crowded_file") | F.col("has_complexity")
    if delegation.critical_violation_auto_delegate:
        delegate = (F.col("critical_count") > 0) | delegate
    if not delegation.enabled:
        delegate = F.lit(False)
    return joined.select(
        *PR_KEY,
        *counts,
        delegate.alias("should_delegate"),
        F.when(blocking, "REQUEST_CHANGES")
        .when(F.col("total_violations") > 0, "COMMENT")
        .otherwise("APPROVE")
        .alias("event"),
        blocking.cast("int").alias("exit_status"),
    )


def review_summary(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        *PR_KEY, "total_files", "total_violations", "critical_count", "error_count", "warning_count", "info_count",
        "files_with_issues",
    )


# ---------------------------------------------------------------------------------------------------------
# comments and reports


def review_comments(violations: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """One comment per violation. ``generated`` may hold a text per critical or error violation
    (``repo, pr_number, file, line, rule_id, generated_body`` and the ``rule_ord, seq`` its prompt carried, without which
    two findings of a rule on one line cannot be told apart), which replaces the message."""
    v = violations
    message = F.col("message")
    if generated is not None:
        key = [*PR_KEY, "file", "line", "rule_id", *(c for c in ("rule_ord", "seq") if c in generated.columns)]
        v = v.join(generated.dropDuplicates(key), key, "left")
        message = F.when(F.col("severity").isin("critical", "error"), F.coalesce("generated_body", "message")).otherwise(
            message
        )
    body = F.when(
        F.length("suggestion") > 0, F.concat(message, F.lit("\n\n**Suggestion:** "), F.col("suggestion"))
    ).otherwise(message)
    order = [c for c in ("file_ord", "rule_ord", "seq") if c in violations.columns]
    return v.select(
        *PR_KEY, *order, "file", "line", body.alias("body"), "severity", "rule_id",
        F.lit(None).cast("string").alias("suggestion_code"),
    )


# The badge of each severity.
BADGES = {"critical": "🚨", "error": "❌", "warning": "⚠️", "info": "ℹ️"}
OTHER_BADGE = "📝"


def comment_body(body: Column, severity: Column, rule_id: Column, suggestion_code: Column) -> Column:
    badge = reduce(
        lambda acc, kv: acc.when(severity == kv[0], kv[1]),
        list(BADGES.items())[1:],
        F.when(severity == "critical", BADGES["critical"]),
    ).otherwise(OTHER_BADGE)
    return F.concat(
        badge,
        F.lit(" **"),
        F.upper(severity),
        F.lit("**"),
        F.when(F.length(rule_id) > 0, F.concat(F.lit(" ["), rule_id, F.lit("]"))).otherwise(""),
        F.lit("\n\n"),
        body,
        F.when(
            F.length(suggestion_code) > 0,
            F.concat(F.lit("\n\n**Suggested fix:**\n```suggestion\n"), suggestion_code, F.lit("\n```")),
        ).otherwise(""),
    )


def comment_rows(comments: DataFrame) -> DataFrame:
    """The flat payload: one row per comment with its formatted body. Also the shape used when a whole review is
    refused and comments are posted one by one."""
    return comments.select(
        *PR_KEY,
        *[c for c in ("file_ord", "rule_ord", "seq") if c in comments.columns],
        F.col("file").alias("path"),
        "line",
        comment_body(F.col("body"), F.col("severity"), F.col("rule_id"), F.col("suggestion_code")).alias("body"),
    )


def review_payload(comments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review payload in parts: one row per file with its comments in order, plus the event of the pull request.

    A part holds the comments of one file, so its size is bounded by the file's text however many files the pull
    request has; a pull request without comments has one part with an empty list. Parts and decisions meet in an inner
    join, of which adaptive execution can split either side, so a pull request with most of the comments is no bottleneck.
    """
    item = F.struct("rule_ord", "line", "seq", "path", "body")
    parts = (
        comment_rows(comments)
        .groupBy(*PR_KEY, "file_ord", F.col("path").alias("part_path"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    out = F.transform(
        "items", lambda x: F.struct(x["path"].alias("path"), x["line"].alias("line"), x["body"].alias("body"))
    )
    none = F.array().cast("array<struct<path:string,line:int,body:string>>")
    full = parts.join(decisions.select(*PR_KEY, "event"), PR_KEY).select(
        *PR_KEY, "event", "file_ord", out.alias("comments")
    )
    empty = decisions.filter(F.col("total_violations") == 0).select(
        *PR_KEY, "event", F.lit(None).cast(parts.schema["file_ord"].dataType).alias("file_ord"), none.alias("comments")
    )
    return full.unionByName(empty)


def summary_markdown(
    decisions: DataFrame, issues: DataFrame, refactored: DataFrame | None = None
) -> DataFrame:
    """The markdown report as rows ``section, file, markdown``; ordered by section and file (nulls first) they are its text.

    Section 0 has one row per pull request with the counts; sections 1 and 2 (files with issues, rewritten files) have a
    heading row without a file and one row per file. ``issues`` and ``refactored`` are ``(repo, pr_number, file)`` tables.
    """
    count_line = lambda label, c: F.concat(F.lit(f"| {label} | "), F.col(c).cast("string"), F.lit(" |"))
    head = decisions.select(
        *PR_KEY,
        F.lit(0).alias("section"),
        F.lit(None).cast("string").alias("file"),
        F.concat_ws(
            "\n",
            F.lit("## 🔍 AI Code Review Summary\n"),
            F.lit("| Metric | Count |"),
            F.lit("|--------|-------|"),
            count_line("Files Reviewed", "total_files"),
            count_line("Total Issues", "total_violations"),
            count_line("🚨 Critical", "critical_count"),
            count_line("❌ Errors", "error_count"),
            count_line("⚠️ Warnings", "warning_count"),
            count_line("ℹ️ Info", "info_count"),
            F.when(F.col("total_violations") == 0, F.lit("\n✅ **No issues found! Great job!**")),
        ).alias("markdown"),
    )
    out = head.unionByName(_section(issues, 1, "\n### Files with Issues\n"))
    if refactored is not None:
        out = out.unionByName(_section(refactored, 2, "\n### 🔧 Automatic Refactoring Applied\n"))
    return out


def _section(files: DataFrame, number: int, heading: str) -> DataFrame:
    """A heading for each pull request with files, and a bullet for each file."""
    keyed = files.select(*PR_KEY, F.lit(number).alias("section"), "file").distinct()
    top = keyed.select(*PR_KEY, "section", F.lit(None).cast("string").alias("file"), F.lit(heading).alias("markdown"))
    return top.distinct().unionByName(
        keyed.withColumn("markdown", F.concat(F.lit("- `"), F.col("file"), F.lit("`")))
    )
