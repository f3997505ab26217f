"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pullscan.functions import text as tx
from pullscan.model import FILE_KEY, PR_KEY
from pullscan.operators import answers as ans
from pullscan.operators import diff, facts, lines, rewrite, testlogs, verify
from pullscan.operators import review as rv
from pullscan.plans import review as plan
from pullscan.rules.checks import Check, register_rule
from pullscan.rules.config import RuleSet, RuleSpec, load_rules, rules_from_dict, rules_table, standard_config
from pullscan.session import shared_path
from pullscan.sources import derived as d
from pullscan.sources import contents, reviewlog, tables
from pullscan.streaming import review as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FK = ["file_ord", "filename"]
V_KEY = ["file_ord", "rule_id", "line", "message", "suggestion", "code_snippet", "confidence"]
AT = "2026-01-01 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def at():
    return F.lit(AT).cast("timestamp")


def inputs(spark, sf, answers: bool = False) -> plan.ReviewInputs:
    changes = d.file_changes(spark, sf)
    reply = None
    if answers:
        reply = d.chunk_answers(diff.added_chunks(rv.analyzable_files(changes), FILE_KEY, 3))
    return plan.ReviewInputs(
        scan_prs(spark, sf), changes, d.file_contents(spark, sf), d.pr_commits(spark, sf), reply,
        tests=last_tests(spark, sf),
    )


def scan_prs(spark, sf):
    return tables.scan_pull_requests(d.pull_requests(spark, sf))


def last_tests(spark, sf):
    """The suite of the latest run per pull request."""
    runs = testlogs.suites(d.ci_logs(spark, sf), [*PR_KEY, "run_id"])
    return runs.groupBy(*PR_KEY).agg(
        F.max_by(F.struct("passed", "total_tests"), "run_id").alias("s")
    ).select(*PR_KEY, "s.passed", "s.total_tests")


def static_inputs(spark, sf) -> plan.ReviewInputs:
    """Only what static analysis reads."""
    return plan.ReviewInputs(d.pull_requests(spark, sf), d.file_changes(spark, sf), d.file_contents(spark, sf))


def violations(spark, sf, answers: bool = False) -> DataFrame:
    i = inputs(spark, sf, answers) if answers else static_inputs(spark, sf)
    return plan.all_violations(plan.reviewed_files(i), i, load_rules())


def decisions(spark, sf) -> DataFrame:
    return rv.pr_decisions(scan_prs(spark, sf), d.file_changes(spark, sf), violations(spark, sf))


def written_violations(spark, sf) -> DataFrame:
    """Computed once where several parts of a query read them."""
    return plan.materialized(violations(spark, sf), spark, "violations")


def results(spark, sf, v: DataFrame | None = None) -> DataFrame:
    v = written_violations(spark, sf) if v is None else v
    return rewrite.apply_fixes(plan.files_to_fix(static_inputs(spark, sf), v), v)


def whole(spark, sf, *rule_ids: str, with_text: bool = False) -> DataFrame:
    """Rules over whole files, without a diff."""
    files = d.source_files(spark, sf, patch=False)
    found = rv.analyze(files, load_rules().only(*rule_ids), with_text=with_text)
    return found.select(*V_KEY, *(["line_text"] if with_text else []))


# --------------------------------------------------------------------------------------------- sources


@query
def scan_pull_requests(spark, sf):
    return scan_prs(spark, sf)


@query
def scan_file_changes(spark, sf):
    return tables.scan_file_changes(d.file_changes(spark, sf)).drop("head_branch")


@query
def file_at_ref(spark, sf):
    return rv.file_at_ref(d.file_changes(spark, sf), scan_prs(spark, sf), d.file_contents(spark, sf)).select(
        *FILE_KEY, "ref", "content"
    )


@query
def file_at_ref_bucketed(spark, sf):
    """The same from contents written in buckets of their key, read back by another definition of the table."""
    path = shared_path(spark, "contents")
    contents.write_contents(d.file_contents(spark, sf), path, 16)
    return rv.file_at_ref(d.file_changes(spark, sf), scan_prs(spark, sf), contents.read_contents(spark, path)).select(
        *FILE_KEY, "ref", "content"
    )


@query
def checked_out_files(spark, sf):
    """Texts read back from one file each, as after a checkout."""
    path = shared_path(spark, "checkout")
    docs = d.read_table(spark, sf, "documents")
    tables.write_files(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "text"), path)
    got = tables.file_contents_from_files(spark, path, "org/docs", "main", "*.txt", tables.WRITTEN)
    return got.select("repo", F.regexp_extract("path", "/name=([^/]+)/", 1).alias("path"), "ref", "sha", "content")


def _rule_counts(spark, sf):
    return violations(spark, sf).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def _rule_usage(spark, sf):
    """The loaded rule table with the number of findings of each rule."""
    table = rules_table(spark, load_rules())
    return table.join(_rule_counts(spark, sf), "rule_id", "left").select(
        "rule_ord", "rule_id", "rule_name", "category", "severity", F.coalesce("n", F.lit(0)).alias("n")
    )


QUERIES["load_rules"] = _rule_usage


@query
def rules_enabled(spark, sf):
    """Findings of a rule file with a rule switched off, one of an unknown name, and one whose pattern is none: the others count."""
    with_state = [{**r, "enabled": r["id"] in ("S002", "SEC001", "BP001", "X001", "X002")} for r in standard_config()["rules"]]
    odd = [
        {"id": "X001", "name": "no_such_rule", "category": "style", "severity": "info"},
        {"id": "X002", "name": "sql_injection", "category": "security", "severity": "critical", "config": {"patterns": ["SELECT("]}},
    ]
    rules = rules_from_dict({"rules": [*with_state, *odd]})
    return rv.analyze(d.source_files(spark, sf, patch=False), rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query
def latest_commit(spark, sf):
    return tables.latest_commit(d.pr_commits(spark, sf))


@query
def rollback_points(spark, sf):
    saved = d.pr_commits(spark, sf).withColumnRenamed("commit_ord", "saved_ord")
    return tables.rollback_points(saved)


@query
def rollback_point_rows(spark, sf):
    saved = d.pr_commits(spark, sf).withColumnRenamed("commit_ord", "saved_ord")
    return tables.numbered_rollback_points(saved)


@query
def commit_plan(spark, sf):
    plans = tables.commit_plan(results(spark, sf), scan_prs(spark, sf), d.file_contents(spark, sf))
    return plans.withColumn("violations_fixed", F.array_join("violations_fixed", ","))


@query
def rollback_plan(spark, sf):
    refs = tables.latest_commit(d.pr_commits(spark, sf)).select(
        *PR_KEY, "sha", F.concat(F.lit("base/"), F.col("pr_number").cast("string")).alias("ref")
    )
    done = results(spark, sf).filter("success")
    return tables.rollback_plan(done, refs, scan_prs(spark, sf), d.file_contents(spark, sf))


@query
def review_payload(spark, sf):
    v = written_violations(spark, sf)
    out = rv.review_payload(rv.review_comments(v), rv.pr_decisions(scan_prs(spark, sf), d.file_changes(spark, sf), v))
    return out.withColumn("comments", F.to_json("comments"))


@query
def review_payload_rows(spark, sf):
    return rv.comment_rows(rv.review_comments(violations(spark, sf))).select("file_ord", "path", "line", "body")


@query
def violations_json(spark, sf):
    return rv.violations_json(violations(spark, sf)).select("file_ord", "violation_json")


def _review(spark, sf, rollback: bool = True) -> tuple[plan.Review, plan.ReviewInputs]:
    i = inputs(spark, sf)
    return plan.review(spark, i, plan.ReviewOptions(materialize=True, enable_rollback=rollback)), i


@query
def review_events_whole(spark, sf):
    """The log of whole reviews, whose rewrites are those of the fixes."""
    r, i = _review(spark, sf)
    return plan.review_events(r, i, at()).select(*EVENT_COLUMNS)


EVENT_COLUMNS = ["repo", "pr_number", "step", "file_ord", "rule_ord", "line", "seq", "event", "value"]


def _pair_review(spark, sf, rollback: bool = True) -> tuple[plan.Review, plan.ReviewInputs]:
    """A review whose rewrites are the derived pairs of the delegated pull requests."""
    i = inputs(spark, sf)
    v = written_violations(spark, sf)
    dec = plan.materialized(rv.pr_decisions(i.pull_requests, d.file_changes(spark, sf, patch=False), v), spark, "decisions")
    # A third of all files is of one pull request: keys alone meet by pull request, texts by file, and as they are read.
    wanted = d.source_files_keys(spark, sf).join(dec.filter("should_delegate").select(*PR_KEY), PR_KEY, "left_semi")
    verified = plan.materialized(verify.verify(d.code_pairs(spark, sf, wanted)), spark, "verified")
    # One row for each pair.
    done = verified.select(*FILE_KEY, F.lit(True).alias("success"))
    i.tests = plan.materialized(i.tests, spark, "tests")
    route = plan.review_route(dec, done, verified, plan.ReviewOptions(enable_rollback=rollback), i.tests, i.commits)
    route = plan.materialized(route, spark, "route")
    return plan.Review(None, v, rv.review_comments(v), dec, done, verified, route), i


@query
def review_events(spark, sf):
    r, i = _pair_review(spark, sf)
    return plan.review_events(r, i, at()).select(*EVENT_COLUMNS)


def _static_events(spark, sf):
    v = violations(spark, sf)
    c = F.col
    return reviewlog.event_rows(v, 4, "rule_triggered", at(), {
        "rule_id": c("rule_id"), "file": c("file"), "line": c("line"), "severity": c("severity")})


@query
def review_log_write(spark, sf):
    return _static_events(spark, sf).select("event_date", "value")


@query
def review_log_scan(spark, sf):
    path = shared_path(spark, "review-log")
    reviewlog.write_review_log(_static_events(spark, sf), path)
    # A range of days reads only their folders.
    log = reviewlog.read_review_log(spark, path, since="2026-01-01", until="2026-01-31")
    return log.select("timestamp", "event", "rule_id", "file", "line", "severity")


@query
def handoff_snapshot(spark, sf):
    i = static_inputs(spark, sf)
    v = written_violations(spark, sf)
    changes = d.file_changes(spark, sf, patch=False)
    snap = tables.handoff_snapshot(changes, i.pull_requests, i.file_contents, results(spark, sf, v), v, reviewlog.iso_utc(at()))
    # Violations are counted before the rows meet their commits, so their texts are not moved.
    restored = tables.restore_snapshot(snap, F.lit("")).withColumn("violations", F.size("violations"))
    return tables.with_commit_counts(restored, _restored_commits(spark, sf)).select(
        "repo", "pr_number", "branch", "filename", "original_code", "refactored_code",
        F.col("violations").alias("n_violations"), "n_commits", "n_rollback_points", "last_point",
        F.array_join("handoff_chain", ",").alias("chain"), "started_at", "version",
    )


def _restored_commits(spark, sf):
    """All commits, and every fourth one as a point to return to, written as records and read back."""
    made = d.pr_commits(spark, sf)
    path = shared_path(spark, "snapshot")
    tables.write_snapshot_commits(tables.snapshot_commits(made, made.filter("commit_ord % 4 = 0")), path)
    return tables.restore_snapshot_commits(spark.read.text(path))


@query
def handoff_commits(spark, sf):
    return _restored_commits(spark, sf)


@query
def handoff_maps(spark, sf):
    return tables.handoff_maps(
        rv.file_at_ref(d.file_changes(spark, sf), scan_prs(spark, sf), d.file_contents(spark, sf))
    )


# --------------------------------------------------------------------------------- projections, filters


@query
def analyzable_files(spark, sf):
    return rv.analyzable_files(d.file_changes(spark, sf)).select(*FILE_KEY, "status")


@query
def file_extension(spark, sf):
    k = d.source_files_keys(spark, sf)
    return k.select("file_ord", "filename", tx.file_extension(F.col("filename")).alias("extension"))


@query
def is_deleted(spark, sf):
    k = d.source_files_keys(spark, sf)
    return k.select("file_ord", rv.is_deleted(F.col("status")).alias("is_deleted"))


@query
def is_added(spark, sf):
    dl = diff.diff_lines(d.file_changes(spark, sf), FK)
    return dl.select(*FK, "hunk_no", "line_number", rv.is_added(F.col("change_type")).alias("is_added"))


@query
def source_lines(spark, sf):
    return lines.source_lines(d.source_files(spark, sf, patch=False), FK)


@query
def source_lines_documents(spark, sf):
    docs = d.read_table(spark, sf, "documents")
    return lines.source_lines(docs, ["doc_id"], "text")


@query
def changed_line_gate(spark, sf):
    return lines.changed_line_gate(d.source_files(spark, sf), FK)


@query
def fixable_files(spark, sf):
    return rv.fixable_files(violations(spark, sf))


def _facts(spark, sf):
    return facts.code_facts(d.python_modules(spark, sf), FK)


@query
def complex_functions(spark, sf):
    return facts.complex_functions(_facts(spark, sf), FK, 4).select(*FK, "name", "complexity")


@query
def long_functions(spark, sf):
    return facts.long_functions(_facts(spark, sf), FK, 6).select(*FK, "name", "start_line", "end_line")


# ------------------------------------------------------------------------------------------------ diff


@query
def diff_present(spark, sf):
    return diff.diff_present(d.file_changes(spark, sf)).select(*FILE_KEY, F.length("patch").alias("n_chars"))


@query
def diff_hunks(spark, sf):
    return diff.diff_hunks(d.file_changes(spark, sf), FK)


@query
def diff_lines(spark, sf):
    return diff.diff_lines(d.file_changes(spark, sf), FK).drop("piece_no", "part_no")


@query
def diff_nested(spark, sf):
    return diff.diff_nested(d.file_changes(spark, sf), FK).select(*FK, F.to_json("hunks").alias("hunks"))


@query
def added_lines(spark, sf):
    return diff.added_lines(d.file_changes(spark, sf), FK).drop("piece_no", "part_no")


@query
def changed_line_numbers(spark, sf):
    return diff.changed_line_numbers(d.file_changes(spark, sf), FK)


@query
def added_chunks(spark, sf):
    return diff.added_chunks(d.file_changes(spark, sf), FK)


@query
def added_chunks_min3(spark, sf):
    return diff.added_chunks(d.file_changes(spark, sf), FK, 3)


# ----------------------------------------------------------------------------------------------- rules


@query
def rule_line_length(spark, sf):
    return whole(spark, sf, "S001", with_text=True)


@query
def rule_naming(spark, sf):
    return whole(spark, sf, "S002")


@query
def rule_complexity(spark, sf):
    return whole(spark, sf, "Q001")


@query
def rule_function_length(spark, sf):
    return whole(spark, sf, "Q002")


@query
def rule_secrets(spark, sf):
    return whole(spark, sf, "SEC001")


@query
def rule_sql_injection(spark, sf):
    return whole(spark, sf, "SEC002")


@query
def rule_error_handling(spark, sf):
    return whole(spark, sf, "BP001")


def _names(spark, sf):
    p = d.read_table(spark, sf, "part")
    return p.select("p_partkey", F.explode(F.array("p_name", "p_brand", "p_type")).alias("name"))


@query
def name_matches(spark, sf):
    n = _names(spark, sf)
    return n.select(
        "p_partkey", "name", *[tx.name_matches(F.col("name"), c).alias(c) for c in tx.CONVENTIONS],
    )


@query
def name_convert(spark, sf):
    n = _names(spark, sf)
    return n.select("p_partkey", "name", *[tx.name_convert(F.col("name"), c).alias(c) for c in tx.CONVENTIONS])


@query
def function_spans(spark, sf):
    return lines.function_spans(d.source_files(spark, sf, patch=False), FK)


@query
def line_complexity(spark, sf):
    ln = lines.source_lines(d.source_files(spark, sf, patch=False), FK)
    return ln.select(*FK, "line", tx.line_complexity(F.col("text")).alias("hits"))


@query
def redact_quotes(spark, sf):
    ln = lines.source_lines(d.source_files(spark, sf, patch=False), FK)
    return ln.select(*FK, "line", tx.redact_quotes(F.col("text")).alias("redacted"))


@query
def analyze(spark, sf):
    return violations(spark, sf)


@query
def analyze_documents(spark, sf):
    """All rules over the given documents as they are: each document is one file."""
    docs = d.read_table(spark, sf, "documents").select(
        F.lit("documents").alias("repo"), F.lit(0).cast("bigint").alias("pr_number"),
        F.col("doc_id").alias("file_ord"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("text").alias("content"),
    )
    return rv.analyze(docs, load_rules()).select(*V_KEY)


@register_rule("todo_comments")
def _todo_comments(rule: RuleSpec) -> list[Check]:
    """Example of a user rule: comment lines with a given word."""
    word = rule.config.get("word", "note")
    text = F.col("text")
    return [
        Check("line", tx.lstrip(text).startswith("#") & text.contains(word),
              F.lit(f"Comment contains '{word}'"), F.lit(""), tx.strip(text), 0.5)
    ]


@query
def custom_rule(spark, sf):
    spec = RuleSpec("X001", "todo_comments", "style", "info", config={"word": "note"})
    return rv.analyze(d.source_files(spark, sf, patch=False), RuleSet((spec,))).select(*V_KEY)


# ----------------------------------------------------------------------------------------------- facts


@query
def facts_regex(spark, sf):
    f = facts.facts_regex(d.source_files(spark, sf, patch=False), FK)
    entry = lambda kind, a, name, line: F.transform(
        F.col(f"facts.{a}"),
        lambda x: F.struct(F.lit(kind).alias("kind"), x[name].alias("name"), x[line].alias("line"),
                           (x["is_async"] if a == "functions" else x["is_from_import"] if a == "imports" else F.lit(False)).alias("flag")),
    )
    rows = F.concat(
        entry("function", "functions", "name", "start_line"), entry("class", "classes", "name", "start_line"),
        entry("import", "imports", "module", "line"),
    )
    return f.select(*FK, F.inline(rows))


@query
def loc_sloc(spark, sf):
    return facts.loc_sloc(d.source_files(spark, sf, patch=False), FK)


@query
def facts_functions(spark, sf):
    f = facts.facts_functions(_facts(spark, sf), FK)
    joined = [F.array_join(c, ",").alias(c) for c in ("parameters", "decorators", "calls")]
    return f.select(
        *FK, "name", "class_name", "start_line", "end_line", "body_start_line", "return_type", "is_async", "docstring",
        "complexity", *joined,
    )


@query
def facts_classes(spark, sf):
    f = facts.facts_classes(_facts(spark, sf), FK)
    return f.select(*FK, "name", "start_line", "end_line", "docstring",
                    *[F.array_join(c, ",").alias(c) for c in ("bases", "methods", "decorators")])


@query
def facts_imports(spark, sf):
    return facts.facts_imports(_facts(spark, sf), FK).withColumn("names", F.array_join("names", ","))


@query
def facts_globals(spark, sf):
    return facts.facts_globals(_facts(spark, sf), FK)


@query
def facts_calls(spark, sf):
    return facts.facts_calls(_facts(spark, sf), FK)


@query
def ast_complexity(spark, sf):
    return facts.facts_functions(_facts(spark, sf), FK).select(*FK, "name", "start_line", "complexity")


@query
def file_complexity_score(spark, sf):
    return _facts(spark, sf).select(*FK, "complexity_score")


@query
def facts_route(spark, sf):
    return _facts(spark, sf).select(*FK, "source", "loc", "sloc")


@query
def function_at_line(spark, sf):
    return facts.function_of_lines(_facts(spark, sf), FK)


@query
def class_at_line(spark, sf):
    return facts.class_of_lines(_facts(spark, sf), FK)


def _positions(spark, sf):
    """Lines asked for from outside: every third line of each module, and one behind its end."""
    ln = lines.source_lines(d.python_modules(spark, sf), FK).select(*FK, "line")
    end = d.python_modules(spark, sf).select(*FK, F.lit(1 << 20).alias("line"))
    return ln.where("line % 3 = 0").unionByName(end)


@query
def function_at_position(spark, sf):
    return facts.function_at_line(_positions(spark, sf), _facts(spark, sf), FK)


@query
def class_at_position(spark, sf):
    return facts.class_at_line(_positions(spark, sf), _facts(spark, sf), FK)


# ------------------------------------------------------------------------------------- joins, roll-ups


@query
def violations_of_file(spark, sf):
    v = written_violations(spark, sf)
    return rv.violations_of_file(v, results(spark, sf, v).filter("success")).select("file", "rule_id", "line")


@query
def violations_per_file(spark, sf):
    return rv.violations_per_file(violations(spark, sf))


@query
def pr_totals(spark, sf):
    return rv.pr_totals(scan_prs(spark, sf), d.file_changes(spark, sf))


@query
def review_summary(spark, sf):
    return rv.review_summary(decisions(spark, sf))


@query
def should_delegate(spark, sf):
    return decisions(spark, sf).select(*PR_KEY, "should_delegate")


@query
def review_event(spark, sf):
    return decisions(spark, sf).select(*PR_KEY, "event")


@query
def exit_status(spark, sf):
    return decisions(spark, sf).select(*PR_KEY, "exit_status")


@query
def distinct_files(spark, sf):
    return rv.distinct_files(violations(spark, sf))


@query
def files_with_issues(spark, sf):
    return rv.files_with_issues(violations(spark, sf, answers=True))


# ------------------------------------------------------------------------------------ comments, reports


@query
def review_comments(spark, sf):
    return rv.review_comments(violations(spark, sf)).select("file_ord", "file", "line", "body", "severity", "rule_id", "suggestion_code")


@query
def review_comments_generated(spark, sf):
    """Comments in which written texts stand in for the messages of the findings they were written for."""
    v = written_violations(spark, sf)
    comments = rv.review_comments(v, d.generated_comments(v))
    return comments.select("file_ord", "rule_ord", "seq", "file", "line", "body", "severity", "rule_id")


@query
def comment_body(spark, sf):
    c = rv.review_comments(violations(spark, sf))
    fence = F.when(F.col("rule_id") == "BP001", F.lit("except Exception as e:"))
    return c.select(
        "file_ord", "line", "rule_id",
        rv.comment_body(F.col("body"), F.col("severity"), F.col("rule_id"), fence).alias("formatted"),
    )


@query
def summary_markdown(spark, sf):
    v = written_violations(spark, sf)
    dec = rv.pr_decisions(scan_prs(spark, sf), d.file_changes(spark, sf), v)
    rewritten = results(spark, sf, v).filter("success").select("repo", "pr_number", F.col("filename").alias("file"))
    return rv.summary_markdown(dec, rv.files_with_issues(v), rewritten)


@query
def infer_category(spark, sf):
    docs = d.read_table(spark, sf, "documents")
    ln = lines.source_lines(docs, ["doc_id"], "text")
    return ln.select("doc_id", "line", tx.infer_category(F.col("text")).alias("category"))


@query
def text_caps(spark, sf):
    docs = d.read_table(spark, sf, "documents")
    return docs.select("doc_id", *[c.alias(k) for k, c in tx.text_caps(F.col("text")).items()])


# -------------------------------------------------------------------------------------------- answers


@query
def prompt_rows(spark, sf):
    i = inputs(spark, sf)
    files = plan.reviewed_files(i)
    v = plan.all_violations(files, i, load_rules())
    return (
        ans.review_prompts(diff.added_chunks(files, FILE_KEY, 3))
        .unionByName(ans.comment_prompts(v), allowMissingColumns=True)
        .unionByName(ans.refactor_prompts(files, v), allowMissingColumns=True)
        .select("file_ord", "start_line", "kind", "prompt")
    )


@query
def first_five_messages(spark, sf):
    v = written_violations(spark, sf)
    return ans.equivalence_prompts(results(spark, sf, v), v, 2000, 5).select("file_ord", "prompt")


@query
def parse_model_json(spark, sf):
    p = ans.parse_model_json(d.model_responses(spark, sf), ["answer_id"])
    i = F.get("issues", F.lit(0))
    return p.select(
        "answer_id", "is_json", "summary", F.size("issues").alias("n_issues"), i["severity"].alias("severity"),
        i["line"].alias("line"), i["description"].alias("description"), i["suggestion"].alias("suggestion"),
    )


@query
def model_issues(spark, sf):
    chunks = diff.added_chunks(rv.analyzable_files(d.file_changes(spark, sf)), FILE_KEY, 3)
    return ans.model_issues(chunks, d.chunk_answers(chunks), with_code=True)


@query
def equivalence_check(spark, sf):
    e = d.equivalence_responses(spark, sf).select("answer_id", ans.parse_equivalence(F.col("response")).alias("parsed"))
    check = verify.semantic_check(F.col("parsed"))
    return e.select("answer_id", check.alias("c")).select("answer_id", "c.status", "c.message")


# ------------------------------------------------------------------------------------------- rewrites


@query
def fix_order(spark, sf):
    return rewrite.fix_order(violations(spark, sf))


@query
def apply_fixes(spark, sf):
    return results(spark, sf).withColumn("violations_fixed", F.array_join("violations_fixed", ","))


@query
def refactor_results(spark, sf):
    """Result shapes for every file with enough findings, with contents that cannot be read among them."""
    i = inputs(spark, sf)
    files = plan.reviewed_files(i)
    v = plan.all_violations(files, i, load_rules())
    unreadable = files.withColumn("content", F.when(F.col("file_ord") % 7 != 0, F.col("content")))
    return rewrite.apply_fixes(unreadable, v).select("file_ord", "changes_description", "success", "error_message")


@query
def model_rewrites(spark, sf):
    """Results with a model's rewrite where no automatic fix applied."""
    i = static_inputs(spark, sf)
    files = plan.reviewed_files(i)
    v = plan.all_violations(files, i, load_rules())
    done = rewrite.with_model_rewrites(rewrite.apply_fixes(files, v), v, d.rewrite_answers(spark, sf))
    return done.select(
        "file_ord", F.md5("refactored_code").alias("code"), "changes_description",
        F.array_join("violations_fixed", ",").alias("violations_fixed"), "success",
    )


@query
def first_three_rules(spark, sf):
    return results(spark, sf).filter("success").select(
        "file_ord", rewrite.commit_message(F.col("violations_fixed")).alias("message")
    )


@query
def fix_naming(spark, sf):
    """The whole-word rename of every naming violation, on the whole text of its file."""
    v = rv.analyze(d.source_files(spark, sf, patch=False), load_rules().only("S002"))
    files = d.source_files(spark, sf, patch=False)
    old = rewrite.defined_name(F.col("code_snippet"))
    new = rewrite.new_name_of(F.col("suggestion"))
    return v.join(files.select("file_ord", "content"), "file_ord").select(
        "file_ord", "line", F.md5(rewrite.rename(F.col("content"), old, new)).alias("renamed")
    )


@query
def fix_bare_except(spark, sf):
    ln = lines.source_lines(d.source_files(spark, sf, patch=False), FK)
    return ln.select("file_ord", "line", rewrite.bare_except_fix(F.col("text")).alias("fixed")).filter("fixed IS NOT NULL")


@query
def fix_secret(spark, sf):
    ln = lines.source_lines(d.source_files(spark, sf, patch=False), FK)
    return (
        ln.select("file_ord", "line", rewrite.secret_fix(F.col("text")).alias("x"))
        .filter("x IS NOT NULL")
        .select("file_ord", "line", F.col("x.line").alias("fixed"), F.col("x.change").alias("change"))
    )


@query
def ensure_import(spark, sf):
    f = d.source_files(spark, sf, patch=False)
    return f.select("file_ord", F.md5(rewrite.ensure_import(F.col("content"))).alias("code"))


# ---------------------------------------------------------------------------------------- verification


def _verified(spark, sf):
    return verify.verify(d.code_pairs(spark, sf))


def _checks(spark, sf, *names):
    c = verify.verification_checks(_verified(spark, sf))
    return c.filter(F.col("name").isin(*names)).select("file_ord", "name", "status", "message")


@query
def verify_syntax(spark, sf):
    return _checks(spark, sf, "syntax_validation").select("file_ord", "name", "status")


@query
def verify_structure(spark, sf):
    c = verify.verification_checks(_verified(spark, sf)).filter("name = 'ast_structure'")
    return c.select(
        "file_ord", "status", "message", F.col("details")["issues"].alias("issues"),
        F.col("details")["original_complexity"].alias("original_complexity"),
        F.col("details")["refactored_functions"].alias("refactored_functions"),
    )


@query
def verify_imports(spark, sf):
    c = verify.verification_checks(_verified(spark, sf)).filter("name = 'import_integrity'")
    return c.select("file_ord", "status", "message", F.col("details")["removed"].alias("removed"))


@query
def verify_critical(spark, sf):
    p = d.code_pairs(spark, sf)
    issues = verify.critical_issues(F.col("original"), F.col("refactored"))
    return p.select("file_ord", F.array_join(issues, "; ").alias("issues")).select(
        "file_ord", "issues", F.when(F.col("issues") == "", "passed").otherwise("failed").alias("status")
    )


@query
def verification_checks(spark, sf):
    return verify.verification_checks(_verified(spark, sf)).select("file_ord", "check_no", "name", "status")


@query
def verification_rollup(spark, sf):
    return verify.verification_results(_verified(spark, sf), ["file_ord"])


@query
def verification_answers(spark, sf):
    """The roll-up with the model's semantic answers among the checks."""
    told = d.pair_answers(spark, sf).select(*FILE_KEY, ans.parse_equivalence(F.col("response")).alias("parsed"))
    return verify.verification_results(verify.verify(d.code_pairs(spark, sf), told), ["file_ord"])


@query
def verification_all(spark, sf):
    return verify.verification_all(scan_prs(spark, sf), verify.verification_results(_verified(spark, sf)))


@query
def removed_names(spark, sf):
    return verify.changed_names(d.code_pairs(spark, sf), True)


@query
def added_names(spark, sf):
    return verify.changed_names(d.code_pairs(spark, sf), False)


# ------------------------------------------------------------------------------------------- test logs


@query
def pytest_suites(spark, sf):
    return testlogs.pytest_suites(d.ci_logs(spark, sf), ["run_id"])


@query
def pytest_results(spark, sf):
    return testlogs.pytest_results(d.ci_logs(spark, sf), ["run_id"])


@query
def unittest_suites(spark, sf):
    return testlogs.unittest_suites(d.ci_logs(spark, sf), ["run_id"])


@query
def success_rate(spark, sf):
    return testlogs.suites(d.ci_logs(spark, sf), ["run_id"]).select("run_id", "success_rate")


@query
def tests_passed(spark, sf):
    return testlogs.tests_passed(testlogs.suites(d.ci_logs(spark, sf), ["run_id"]), ["run_id"])


@query
def discover_tests(spark, sf):
    return testlogs.discover_tests(d.repo_tree(spark, sf))


def _changed(spark, sf):
    return d.source_files_keys(spark, sf).filter("status <> 'removed'")


@query
def related_tests(spark, sf):
    return testlogs.related_tests(_changed(spark, sf), d.repo_tree(spark, sf))


@query
def detect_framework(spark, sf):
    return testlogs.detect_framework(d.repo_tree(spark, sf), d.requirements(spark, sf))


@query
def tests_to_run(spark, sf):
    return testlogs.tests_to_run(scan_prs(spark, sf), _changed(spark, sf), d.repo_tree(spark, sf))


@query
def test_list(spark, sf):
    return testlogs.test_list(scan_prs(spark, sf), _changed(spark, sf), d.repo_tree(spark, sf))


# -------------------------------------------------------------------------------------------- routing


@query
def review_route_whole(spark, sf):
    r, _ = _review(spark, sf)
    return r.route


@query
def review_route(spark, sf):
    return _pair_review(spark, sf)[0].route


@query
def review_route_kept(spark, sf):
    """The same where nothing is ever rolled back."""
    return _pair_review(spark, sf, rollback=False)[0].route


@query
def mark_refactored(spark, sf):
    r, _ = _pair_review(spark, sf)
    return plan.mark_refactored(r.route, r.results)


@query
def mark_refactored_kept(spark, sf):
    r, _ = _pair_review(spark, sf, rollback=False)
    return plan.mark_refactored(r.route, r.results)


@query
def mark_refactored_whole(spark, sf):
    r, _ = _review(spark, sf, rollback=False)
    return plan.mark_refactored(r.route, r.results)


def _streamed(spark, sf) -> str:
    """The documents as a stream of arriving files, reviewed until all input is read; the root of the written tables."""
    # The table is one file or a folder of them. Written as a pattern that only its own name fits, both are read alike.
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    arriving = streaming.read_file_stream(spark, f"{sf}/documents.parque[t]", schema).select(
        F.lit("documents").alias("repo"), F.lit(0).cast("bigint").alias("pr_number"),
        F.col("doc_id").alias("file_ord"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"),
        F.md5("text").alias("head_sha"), F.col("text").alias("content"), "arrived", *streaming.DELIVERY,
    )
    root = shared_path(spark, "stream")
    streaming.start_review(arriving, load_rules(), f"{root}/out", f"{root}/state", once=True).awaitTermination()
    return f"{root}/out"


@query
def stream_review(spark, sf):
    return streaming.read_violations(spark, _streamed(spark, sf)).select(*V_KEY)


@query
def stream_events(spark, sf):
    """The log the stream wrote, without its times."""
    log = streaming.read_events(spark, _streamed(spark, sf))
    return log.select("event", "pr", "files_count", "rule_id", "file", "line", "severity", "body", "total_violations", "comments_posted")
