"""Prompt columns to send to a model and the tables read back from it. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.functions import text as tx
from pullscan.functions.once import compute_once
from pullscan.model import FILE_KEY, PR_KEY
from pullscan.rules.checks import filled

# Prompt texts.
REVIEW_SYSTEM = (
    "You are an expert code reviewer. Analyze code for issues and provide actionable feedback.\n"
    'Always respond in valid JSON format with: {"issues": [{"severity": "...", "line": null, '
    '"description": "...", "suggestion": "..."}], "summary": "..."}'
)
COMMENT_SYSTEM = (
    "You are a helpful code reviewer. Generate clear, actionable review comments. Be concise but thorough."
)
REFACTOR_SYSTEM = (
    "You are an expert code refactorer. Fix code issues while preserving functionality.\n"
    'Always respond in valid JSON: {"refactored_code": "...", "explanation": "..."}'
)
REVIEW_FOCUS = "security, bugs, best practices"
REVIEW_PROMPT = (
    "Analyze this code focusing on " + REVIEW_FOCUS + ":\n\n```\n", "\n```\n\nContext: File: ", "\n\nProvide your analysis as JSON.",
)
COMMENT_PROMPT = (
    "Generate a review comment for this code issue:\n\nViolation type: ", "\nMessage: ", "\n\nCode:\n```\n",
    "\n```\n\nWrite a helpful, professional comment.",
)
REFACTOR_PROMPT = ("Refactor this code to fix:\n\n", "\n\nOriginal code:\n```\n", "\n```")
EQUIVALENCE_PROMPT = (
    "Analyze these two code versions and determine if they are semantically equivalent\n"
    "(produce the same behavior), accounting for the fact that the refactored version was modified to fix these issues:\n",
    "\n\nORIGINAL CODE:\n```python\n",
    "\n```\n\nREFACTORED CODE:\n```python\n",
    '\n```\n\nRespond with JSON:\n{\n    "equivalent": true/false,\n    "confidence": 0.0-1.0,\n'
    '    "differences": ["list of behavioral differences if any"],\n    "assessment": "brief explanation"\n}',
)


def review_prompt(code: Column, filename: Column) -> Column:
    return filled(REVIEW_PROMPT, code, filename)


def comment_prompt(code: Column, rule_name: Column, message: Column) -> Column:
    return filled(COMMENT_PROMPT, rule_name, message, code)


def refactor_prompt(code: Column, issues: Column) -> Column:
    listed = F.array_join(F.transform(issues, lambda i: F.concat(F.lit("- "), i)), "\n")
    return filled(REFACTOR_PROMPT, listed, code)


def equivalence_prompt(
    original: Column, refactored: Column, messages: Column, max_chars: int | None = None, max_messages: int | None = None
) -> Column:
    """Names the messages and shows both versions, whole unless a limit is given."""
    if max_chars is not None:
        original, refactored = tx.prefix(original, max_chars), tx.prefix(refactored, max_chars)
    named = F.array_join(messages if max_messages is None else F.slice(messages, 1, max_messages), ", ")
    return filled(EQUIVALENCE_PROMPT, named, original, refactored)


def review_prompts(chunks: DataFrame) -> DataFrame:
    """One prompt per added chunk of at least three lines."""
    return chunks.filter(F.col("n_lines") >= 3).select(
        *FILE_KEY, "start_line", F.lit("review").alias("kind"), F.lit(REVIEW_SYSTEM).alias("system"),
        review_prompt(F.col("code"), F.col("filename")).alias("prompt"),
    )


def comment_prompts(violations: DataFrame) -> DataFrame:
    """One prompt per critical or error violation."""
    order = [c for c in ("rule_ord", "seq") if c in violations.columns]
    return violations.filter(F.col("severity").isin("critical", "error")).select(
        *PR_KEY, "file_ord", "rule_id", *order, F.col("file").alias("filename"), F.col("line").alias("start_line"),
        F.lit("comment").alias("kind"), F.lit(COMMENT_SYSTEM).alias("system"),
        comment_prompt(F.col("code_snippet"), F.col("rule_name"), F.col("message")).alias("prompt"),
    )


def file_messages(violations: DataFrame) -> DataFrame:
    """Violation messages of each file in report order, with their lines. Bounded by the file's own lines."""
    item = F.struct("rule_ord", "line", "seq", "message")
    return violations.groupBy(*PR_KEY, F.col("file").alias("filename")).agg(
        F.sort_array(F.collect_list(item)).alias("items")
    )


def refactor_prompts(files: DataFrame, violations: DataFrame) -> DataFrame:
    """One prompt per file with violations, listing them with their lines."""
    issues = F.transform(
        "items", lambda v: F.concat(F.lit("Line "), v["line"].cast("string"), F.lit(": "), v["message"])
    )
    return files.join(file_messages(violations), [*PR_KEY, "filename"]).select(
        *FILE_KEY, F.lit(0).alias("start_line"), F.lit("refactor").alias("kind"),
        F.lit(REFACTOR_SYSTEM).alias("system"), refactor_prompt(F.col("content"), issues).alias("prompt"),
    )


def equivalence_prompts(
    results: DataFrame, violations: DataFrame, max_chars: int | None = None, max_messages: int | None = None
) -> DataFrame:
    """One prompt per successful rewrite; ``max_chars`` and ``max_messages`` shorten it, by default nothing is cut."""
    messages = F.transform("items", lambda v: v["message"])
    return (
        results.filter("success")
        .join(file_messages(violations), [*PR_KEY, "filename"])
        .select(
            *FILE_KEY, F.lit(0).alias("start_line"), F.lit("equivalence").alias("kind"),
            F.lit(None).cast("string").alias("system"),
            equivalence_prompt(F.col("original_code"), F.col("refactored_code"), messages, max_chars, max_messages).alias("prompt"),
        )
    )


# ---------------------------------------------------------------------------------------------------------
# answers

ISSUE_TYPE = "struct<severity:string,line:int,description:string,suggestion:string>"
REVIEW_ANSWER = f"issues array<{ISSUE_TYPE}>, summary string"
EQUIVALENCE_ANSWER = "equivalent boolean, confidence double, differences array<string>, assessment string"
REFACTOR_ANSWER = "refactored_code string, explanation string"

_FENCE = r"(?Uds)```(?:json)?\s*\n?(.*?)\n?```"


#: Strict JSON but for NaN and infinities, which Python's reader takes as well.
_STRICT = {"allowSingleQuotes": "false"}


def _valid(text: Column) -> Column:
    """The text if it is one JSON value and nothing else. Of a repeated key the last one counts.

    The reader stops at the end of a value, whatever follows. So the text is put inside an array and inside an object: what follows
    it, or closes too much, breaks at least one of the two.
    """
    inside = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    below = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "map<string,string>", _STRICT)
    return F.when((F.size(inside) == 1) & (F.size(below) == 1), text)


def json_text(response: Column) -> Column:
    """The JSON in a response: the whole text, else a fenced block, else from the first ``{`` to the last ``}``;
    null when none of them parses."""
    fenced = F.when(response.rlike(_FENCE), F.regexp_extract(response, _FENCE, 1))
    start = F.locate("{", response)
    last = F.length(response) - F.locate("}", F.reverse(response)) + 1
    between = F.when(
        (start > 0) & response.contains("}") & (last >= start), F.substring(response, start, last - start + 1)
    )
    return F.coalesce(_valid(response), _valid(fenced), _valid(between))


def _is_object(json: Column) -> Column:
    return F.ltrim(json, F.lit(" \t\r\n")).startswith("{")


def parse_model_json(answers: DataFrame, keys: list[str], response: str = "response") -> DataFrame:
    """Issues and summary; an unreadable answer has no issues and its first 500 characters as the summary, beside the whole
    ``response``."""
    parsed = compute_once(answers, [*keys, response], {"json": json_text(F.col(response))})
    # Reading null JSON gives null fields, so one projection serves both cases.
    read = compute_once(parsed, [*keys, response, "json"], {"a": F.from_json("json", REVIEW_ANSWER)})
    return read.select(
        *keys,
        F.col(response).alias("response"),
        F.col("json").isNotNull().alias("is_json"),
        F.coalesce("a.issues", F.array().cast(f"array<{ISSUE_TYPE}>")).alias("issues"),
        F.when(F.col("json").isNull(), tx.prefix(F.col(response), 500)).otherwise(F.col("a.summary")).alias("summary"),
    )


def model_issues(chunks: DataFrame, answers: DataFrame, with_code: bool = False) -> DataFrame:
    """Answers as LLM001 violations of their chunk.

    ``answers``: ``repo, pr_number, filename, start_line, response``. Only chunks of at least three lines are asked
    about. A severity outside the vocabulary becomes a warning; a reported line counts from the chunk's start. The snippet
    has the first 200 characters; ``with_code`` adds the whole chunk.
    """
    parsed = parse_model_json(answers, [*PR_KEY, "filename", "start_line"])
    asked = chunks.filter(F.col("n_lines") >= 3).select(*FILE_KEY, "chunk_no", "start_line", "code")
    i = F.col("i")
    severity = F.lower(F.coalesce(i["severity"], F.lit("warning")))
    return (
        asked.join(parsed, [*PR_KEY, "filename", "start_line"])
        .select(*FILE_KEY, "chunk_no", "start_line", "code", F.posexplode("issues").alias("issue_no", "i"))
        .select(
            *PR_KEY,
            "file_ord",
            # After all static rules, in chunk order.
            (F.lit(1000) + F.col("chunk_no")).alias("rule_ord"),
            F.col("issue_no").alias("seq"),
            F.lit("LLM001").alias("rule_id"),
            F.lit("llm_analysis").alias("rule_name"),
            tx.infer_category(F.coalesce(i["description"], F.lit(""))).alias("category"),
            F.when(severity.isin("critical", "error", "warning", "info"), severity).otherwise("warning").alias("severity"),
            F.col("filename").alias("file"),
            F.when(F.coalesce(i["line"], F.lit(0)) != 0, F.col("start_line") + i["line"] - 1)
            .otherwise(F.col("start_line"))
            .alias("line"),
            F.lit(0).alias("column"),
            F.coalesce(i["description"], F.lit("Issue detected by AI analysis")).alias("message"),
            F.coalesce(i["suggestion"], F.lit("")).alias("suggestion"),
            tx.prefix(F.col("code"), 200).alias("code_snippet"),
            F.lit(0.8).alias("confidence"),
            *(["code"] if with_code else []),
        )
    )


def parse_equivalence(response: Column) -> Column:
    """struct for the semantic check. A text without JSON counts as an answer without fields, as it carries no
    statement; JSON that is no object, or a missing response, is null."""
    json = json_text(response)
    text = F.when(response.isNull(), F.lit(None)).when(json.isNull(), F.lit("{}")).when(_is_object(json), json)
    return F.from_json(text, EQUIVALENCE_ANSWER)


def parse_refactoring(response: Column) -> Column:
    """``struct<refactored_code, explanation>``; null unless the answer is a JSON object with a text that is not empty."""
    json = json_text(response)
    answer = F.from_json(F.when(_is_object(json), json), REFACTOR_ANSWER)
    return F.when(F.length(answer["refactored_code"]) > 0, answer)
