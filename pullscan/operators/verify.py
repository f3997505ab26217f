"""Before/after verification of rewritten files. Both versions sit in one row, so every check is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.functions import text as tx
from pullscan.functions.once import compute_once, let
from pullscan.model import FILE_KEY, PR_KEY
from pullscan.operators.facts import OUTLINE_TYPE, python_outlines, python_pair, regex_facts

CHECK_TYPE = "struct<name:string,status:string,message:string,details:map<string,string>>"

# Word stems of security code and what their loss is called.
SECURITY_WORDS = (
    ("auth", "authentication"),
    ("verify", "verification"),
    ("encrypt", "encryption"),
    ("decrypt", "decryption"),
    ("hash", "hashing"),
    ("sanitize", "sanitization"),
    ("validate", "validation"),
)
# Letters outside ASCII that a pattern without case takes for an ASCII letter, and these letters.
ODD_LETTERS, PLAIN_LETTERS = "\u017f\u0130\u0131\u212a", "siik"


def _check(name: str, status: str, message: Column | str, details: dict[str, Column] | None = None) -> Column:
    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(status).alias("status"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("details"),
    ).cast(CHECK_TYPE)


def _set_text(names: Column) -> Column:
    """A set as text with sorted members: ``{'a', 'b'}``."""
    quoted = F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    return F.concat(F.lit("{"), F.array_join(quoted, ", "), F.lit("}"))


def _outline(parsed: Column, content: Column) -> Column:
    """Distinct sorted names and the score of one version; by pattern, and without a score, where the text was not parsed.
    Methods are not functions here."""

    def named(items: Column) -> Column:
        return F.array_sort(F.array_distinct(items))

    by_pattern = let(
        regex_facts(tx.split_lines(content)),
        lambda f: F.struct(
            named(F.transform(f["functions"], lambda x: x["name"])).alias("functions"),
            named(F.transform(f["classes"], lambda x: x["name"])).alias("classes"),
            named(F.transform(f["imports"], lambda x: x["module"])).alias("imports"),
            F.lit(0).alias("score"),
        ),
    )
    nothing = F.struct(*(F.lit(None).alias(k) for k in ("functions", "classes", "imports")), F.lit(0).alias("score"))
    return F.coalesce(parsed, F.when(content.isNotNull(), by_pattern), nothing.cast(OUTLINE_TYPE))


def with_pair_facts(pairs: DataFrame, keys: list[str], filename: str = "filename", syntax: bool = True) -> DataFrame:
    """``syntax`` of the rewritten text, unless left out, and names and scores of both versions, from one pass over each pair.

    Texts leave for Python once; what comes back are names and numbers, not whole facts.
    """
    keep = [c for c in pairs.columns if c in (*keys, "original", "refactored")]
    is_python = F.coalesce(tx.path_suffix(F.col(filename)) == ".py", F.lit(False))
    made = python_pair if syntax else python_outlines
    pair = pairs.withColumn("pair", made(F.col("original"), F.col("refactored"), is_python))
    syntax_ = [F.col("pair.syntax").alias("syntax")] if syntax else []
    both = compute_once(
        pair,
        [*keep, *syntax_],
        {"of": _outline(F.col("pair.before"), F.col("original")), "rf": _outline(F.col("pair.after"), F.col("refactored"))},
    )
    return both.select(
        *keep, *(["syntax"] if syntax else []),
        *(F.col(f"{v}.{k}").alias(f"{v}_{k}") for v in ("of", "rf") for k in ("functions", "classes", "imports", "score")),
    )


def changed_names(pairs: DataFrame, removed: bool, keys: list[str] = FILE_KEY) -> DataFrame:
    """Names of functions, classes and imports that disappeared (or appeared), one row each."""
    a, b = ("of", "rf") if removed else ("rf", "of")
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.array_except(F.col(f"{a}_{k}"), F.col(f"{b}_{k}")).alias("names"))
            for k in ("functions", "classes", "imports")
        ]
    )
    return with_pair_facts(pairs, keys, syntax=False).select(*keys, F.inline(kinds)).select(
        *keys, "kind", F.explode("names").alias("name")
    )


def syntax_check(syntax: Column) -> Column:
    return F.when(
        syntax["ok"], _check("syntax_validation", "passed", "Code has valid Python syntax")
    ).otherwise(
        _check(
            "syntax_validation",
            "failed",
            F.concat(
                F.lit("Syntax error at line "), F.coalesce(syntax["line"].cast("string"), F.lit("None")), F.lit(": "),
                syntax["message"],
            ),
            {"line": syntax["line"], "offset": syntax["offset"], "text": syntax["text"]},
        )
    )


def structure_check() -> Column:
    """Removed functions or classes, or a score above one and a half times the original, give a warning."""
    removed_f = F.array_except("of_functions", "rf_functions")
    removed_c = F.array_except("of_classes", "rf_classes")
    issues = F.array_compact(
        F.array(
            F.when(F.size(removed_f) > 0, F.concat(F.lit("Functions removed/renamed: "), _set_text(removed_f))),
            F.when(F.size(removed_c) > 0, F.concat(F.lit("Classes removed/renamed: "), _set_text(removed_c))),
            F.when(
                F.col("rf_score") > F.col("of_score") * 1.5,
                F.concat(
                    F.lit("Complexity increased significantly: "), F.col("of_score").cast("string"), F.lit(" -> "),
                    F.col("rf_score").cast("string"),
                ),
            ),
        )
    )
    return F.when(
        F.size(issues) > 0,
        _check("ast_structure", "warning", "AST structure changed significantly", {"issues": F.to_json(issues)}),
    ).otherwise(
        _check(
            "ast_structure",
            "passed",
            "AST structure is reasonably preserved",
            {
                "original_functions": F.size("of_functions"),
                "refactored_functions": F.size("rf_functions"),
                "original_complexity": F.col("of_score"),
                "refactored_complexity": F.col("rf_score"),
            },
        )
    )


def imports_check() -> Column:
    removed = F.array_except("of_imports", "rf_imports")
    added = F.array_except("rf_imports", "of_imports")
    return F.when(
        F.size(removed) > 0,
        _check(
            "import_integrity",
            "warning",
            F.concat(F.lit("Some imports were removed: "), _set_text(removed)),
            {"removed": F.to_json(removed), "added": F.to_json(added)},
        ),
    ).otherwise(
        _check("import_integrity", "passed", "Import integrity maintained", {"added_imports": F.to_json(added)})
    )


def critical_issues(original: Column, refactored: Column) -> Column:
    """array<string>: groups of security words, error handling and logging that vanished altogether."""

    def lost(there, pattern, label):
        # "any left" needs only the first match, so no counting.
        return F.when(there & original.rlike(pattern) & ~refactored.rlike(pattern), F.lit(label))

    # Patterns are looked for only where their letters are, whatever their case; that is the dearer search.
    return let(
        # Odd letters take more bytes than one; most texts have none, and replacing goes through a text letter by letter.
        F.lower(
            F.when(F.octet_length(original) == F.char_length(original), original)
            .otherwise(F.translate(original, ODD_LETTERS, PLAIN_LETTERS))
        ),
        lambda low: F.array_compact(
            F.array(
                *[
                    lost(low.contains(stem), tx.FLAGS_NOCASE + tx.NOT_AFTER_WORD + stem, f"All {label} code was removed")
                    for stem, label in SECURITY_WORDS
                ],
                F.when(
                    original.contains("try:") & ~refactored.contains("try:"), F.lit("All try/except blocks were removed")
                ),
                lost(
                    original.contains("logger."), tx.FLAGS + tx.NOT_AFTER_WORD + r"logger\." + tx.WORD + r"+\(",
                    "All logging statements were removed",
                ),
            )
        ),
    )


def critical_check(issues: Column) -> Column:
    return F.when(
        F.size(issues) > 0,
        _check(
            "critical_changes",
            "failed",
            "Critical code may have been inappropriately removed",
            {"issues": F.to_json(issues)},
        ),
    ).otherwise(_check("critical_changes", "passed", "No critical changes detected"))


def semantic_check(parsed: Column) -> Column:
    """Check from a parsed answer (``equivalent, confidence, differences, assessment``); null answer: unreadable."""
    confidence = F.coalesce(parsed["confidence"], F.lit(0.5))
    equivalent = F.coalesce(parsed["equivalent"], F.lit(False))
    differences = F.to_json(F.coalesce(parsed["differences"], F.array().cast("array<string>")))
    return (
        F.when(
            parsed.isNull(),
            _check("semantic_equivalence", "warning", "Could not verify semantic equivalence: no answer"),
        )
        .when(
            equivalent & (confidence >= 0.8),
            _check(
                "semantic_equivalence", "passed", "Code appears semantically equivalent",
                {"confidence": confidence, "assessment": F.coalesce(parsed["assessment"], F.lit(""))},
            ),
        )
        .when(
            equivalent & (confidence >= 0.5),
            _check(
                "semantic_equivalence", "warning", "Code may be semantically equivalent (low confidence)",
                {"confidence": confidence, "differences": differences},
            ),
        )
        .otherwise(
            _check(
                "semantic_equivalence", "failed", "Code may not be semantically equivalent",
                {"confidence": confidence, "differences": differences},
            )
        )
    )


def verify(pairs: DataFrame, answers: DataFrame | None = None, keys: list[str] = FILE_KEY) -> DataFrame:
    """One row per rewritten file with its ``checks`` array. A syntax error drops all later checks.

    ``answers`` optionally holds ``keys + parsed`` semantic answers; without it there is no semantic check.
    """
    p = with_pair_facts(pairs, keys)
    p = compute_once(
        p, [c for c in p.columns if c not in ("original", "refactored")],
        {"critical": critical_issues(F.col("original"), F.col("refactored"))},
    )
    first, rest = syntax_check(F.col("syntax")), [structure_check(), imports_check(), critical_check(F.col("critical"))]
    made = compute_once(
        p, keys, {"checks": F.when(F.col("syntax.ok"), F.array(first, *rest)).otherwise(F.array(first))}
    )
    if answers is None:
        return made
    # The answers meet the finished checks: neither text is moved or sorted by the join.
    told = made.join(answers.select(*keys, "parsed"), keys, "left")
    whole = F.get("checks", F.lit(0))["status"] == "passed"
    return compute_once(
        told, keys,
        {"checks": F.when(whole, F.concat("checks", F.array(semantic_check(F.col("parsed"))))).otherwise(F.col("checks"))},
    )


def verification_checks(verified: DataFrame, keys: list[str] = FILE_KEY) -> DataFrame:
    return verified.select(*keys, F.posexplode("checks").alias("check_no", "c")).select(*keys, "check_no", "c.*")


def verification_results(verified: DataFrame, keys: list[str] = FILE_KEY) -> DataFrame:
    """Passed, safe to commit, needs a human, and the overall message."""
    n = lambda status: F.size(F.filter("checks", lambda c: c["status"] == status))
    counted = verified.select(
        *keys,
        (F.get("checks", F.lit(0))["status"] == "failed").alias("bad_syntax"),
        n("failed").alias("failed"),
        n("warning").alias("warnings"),
        F.exists("checks", lambda c: (c["name"] == "semantic_equivalence") & (c["status"] == "warning")).alias("unsure"),
    )
    passed = F.col("failed") == 0
    return counted.select(
        *keys,
        passed.alias("passed"),
        passed.alias("safe_to_commit"),
        (~F.col("bad_syntax") & (F.col("unsure") | (passed & (F.col("warnings") > 0)))).alias("requires_human_review"),
        F.when(F.col("bad_syntax"), "Refactored code has syntax errors")
        .when(~passed, F.concat(F.lit("Verification failed: "), F.col("failed").cast("string"), F.lit(" checks failed")))
        .when(
            F.col("warnings") > 0,
            F.concat(F.lit("Verification passed with "), F.col("warnings").cast("string"), F.lit(" warnings")),
        )
        .otherwise("All verification checks passed")
        .alias("overall_message"),
    )


def verification_all(pull_requests: DataFrame, results: DataFrame) -> DataFrame:
    """Whether every rewritten file of a pull request passed; true when there is none."""
    per_pr = results.groupBy(*PR_KEY).agg(F.bool_and("passed").alias("all_passed"))
    return pull_requests.select(*PR_KEY).join(per_pr, PR_KEY, "left").select(
        *PR_KEY, F.coalesce("all_passed", F.lit(True)).alias("verification_passed")
    )
