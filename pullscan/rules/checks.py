"""Rule checks as column expressions over review units.

A check is one possible violation per unit. ``line`` units carry ``line, text, next_text`` (the next line of the
whole file, null at the end); ``function`` units carry ``line, fn_name, fn_complexity, fn_lines, fn_blank,
fn_comment``. A rule is a function ``RuleSpec -> list[Check]`` registered under its name, so a new rule needs no
UDF: see ``register_rule``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pullscan.functions import text as tx
from pullscan.rules.config import RuleSpec


@dataclass
class Check:
    unit: str  # "line" or "function"
    when: Column
    message: Column
    suggestion: Column
    snippet: Column
    confidence: float = 1.0
    seq: int = 0


RuleFn = Callable[[RuleSpec], list[Check]]
CHECKS: dict[str, RuleFn] = {}


def register_rule(name: str) -> Callable[[RuleFn], RuleFn]:
    """Register a rule under the name used in rule files."""

    def add(fn: RuleFn) -> RuleFn:
        CHECKS[name] = fn
        return fn

    return add


# Messages and suggestions of the rules.
LINE_MESSAGE = ("Line exceeds ", " characters (length: ", ")")
LINE_SUGGESTION = "Break this line into multiple lines or refactor for readability"
NAME_MESSAGE = (" '", "' should use ")
NAME_SUGGESTION = ("Rename to '", "'")
COMPLEXITY_MESSAGE = ("Function '", "' has cyclomatic complexity of ", " (max: ", ")")
COMPLEXITY_SUGGESTION = "Consider breaking this function into smaller, focused functions"
LENGTH_MESSAGE = ("Function '", "' is ", " lines long (max: ", ")")
LENGTH_SUGGESTION = "Consider extracting parts into smaller helper functions"
SECRET_MESSAGE = "Potential hardcoded secret or credential detected"
SECRET_SUGGESTION = "Use environment variables or a secrets manager instead"
SQL_MESSAGE = "Potential SQL injection vulnerability - using string formatting in SQL query"
SQL_SUGGESTION = "Use parameterized queries: cursor.execute('SELECT * FROM users WHERE id = ?', (user_id,))"
BARE_MESSAGE = "Bare 'except:' clause catches all exceptions including SystemExit and KeyboardInterrupt"
BARE_SUGGESTION = "Catch specific exceptions: 'except (ValueError, TypeError) as e:'"
EMPTY_MESSAGE = "Empty exception handler - exceptions are silently ignored"
EMPTY_SUGGESTION = "Log the exception or handle it appropriately"


def filled(parts: tuple[str, ...], *values: Column) -> Column:
    """A message with its values between the parts."""
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [value.cast("string"), F.lit(part)]
    return F.concat(*out)


DEF = tx.FLAGS + "^" + tx.WS + r"*(?:async" + tx.WS + r"+)?def" + tx.WS + "+(" + tx.WORD + "+)" + tx.WS + r"*\("
CLASS = tx.FLAGS + "^" + tx.WS + "*class" + tx.WS + "+(" + tx.WORD + "+)" + tx.WS + r"*[:\(]"
BARE_EXCEPT = tx.FLAGS + "^" + tx.WS + "*except" + tx.WS + "*:"
BROAD_EXCEPT = tx.FLAGS + "^" + tx.WS + "*except" + tx.WS + "+Exception" + tx.WS + "*:"


def is_def(line: Column) -> Column:
    # The cheap substring test keeps the regex off most lines; every match contains the word.
    return line.contains("def") & line.rlike(DEF)


def def_name(line: Column) -> Column:
    return F.regexp_extract(line, DEF, 1)


@register_rule("line_length")
def line_length(rule: RuleSpec) -> list[Check]:
    limit = rule.config.get("max_length", 120)
    text = F.col("text")
    when = F.length(text) > limit
    if rule.config.get("ignore_urls", True):
        when = when & ~(text.contains("http://") | text.contains("https://"))
    if rule.config.get("ignore_imports", True):
        # strip() may also take the blank after a lone keyword, so test the stripped text.
        s = tx.strip(text)
        when = when & ~(s.startswith("import ") | s.startswith("from "))
    return [
        Check(
            "line",
            when,
            filled(LINE_MESSAGE, F.lit(limit), F.length(text)),
            F.lit(LINE_SUGGESTION),
            F.when(F.length(text) > 100, F.concat(tx.prefix(text, 100), F.lit("..."))).otherwise(text),
        )
    ]


@register_rule("naming_conventions")
def naming_conventions(rule: RuleSpec) -> list[Check]:
    patterns = rule.config.get("patterns", {})
    text = F.col("text")
    out = []
    for seq, (label, regex, word, key, fallback) in enumerate(
        [
            ("Function", DEF, "def", "functions", "snake_case"),
            ("Class", CLASS, "class", "classes", "PascalCase"),
        ]
    ):
        convention = patterns.get(key, fallback)
        name = F.regexp_extract(text, regex, 1)
        when = text.contains(word) & text.rlike(regex) & ~tx.name_matches(name, convention)
        if label == "Function":
            when = when & ~name.startswith("_")
        out.append(
            Check(
                "line",
                when,
                F.concat(F.lit(label), filled((*NAME_MESSAGE, ""), name, F.lit(convention))),
                filled(NAME_SUGGESTION, tx.name_convert(name, convention)),
                tx.strip(text),
                seq=seq,
            )
        )
    return out


@register_rule("function_complexity")
def function_complexity(rule: RuleSpec) -> list[Check]:
    limit = rule.config.get("max_cyclomatic_complexity", 10)
    return [
        Check(
            "function",
            F.col("fn_complexity") > limit,
            filled(COMPLEXITY_MESSAGE, F.col("fn_name"), F.col("fn_complexity"), F.lit(limit)),
            F.lit(COMPLEXITY_SUGGESTION),
            F.lit(""),
            0.9,
        )
    ]


@register_rule("function_length")
def function_length(rule: RuleSpec) -> list[Check]:
    limit = rule.config.get("max_lines", 50)
    counted = F.col("fn_lines")
    if rule.config.get("exclude_blank_lines", True):
        counted = counted - F.col("fn_blank")
    if rule.config.get("exclude_comments", True):
        counted = counted - F.col("fn_comment")
    return [
        Check(
            "function",
            counted > limit,
            filled(LENGTH_MESSAGE, F.col("fn_name"), counted, F.lit(limit)),
            F.lit(LENGTH_SUGGESTION),
            F.lit(""),
        )
    ]


@register_rule("hardcoded_secrets")
def hardcoded_secrets(rule: RuleSpec) -> list[Check]:
    text = F.col("text")
    hit = tx.rlike_any(text, rule.config.get("patterns", []))
    excluded = tx.rlike_any(text, rule.config.get("exclude_patterns", []))
    return [
        Check(
            "line",
            hit & ~excluded,
            F.lit(SECRET_MESSAGE),
            F.lit(SECRET_SUGGESTION),
            tx.redact_quotes(text),
            0.85,
        )
    ]


@register_rule("sql_injection")
def sql_injection(rule: RuleSpec) -> list[Check]:
    text = F.col("text")
    return [
        Check(
            "line",
            tx.rlike_any(text, rule.config.get("patterns", [])),
            F.lit(SQL_MESSAGE),
            F.lit(SQL_SUGGESTION),
            tx.strip(text),
        )
    ]


@register_rule("error_handling")
def error_handling(rule: RuleSpec) -> list[Check]:
    checks = rule.config.get("checks", {})
    text = F.col("text")
    out = []
    if checks.get("bare_except", True):
        out.append(
            Check(
                "line",
                text.contains("except") & text.rlike(BARE_EXCEPT),
                F.lit(BARE_MESSAGE),
                F.lit(BARE_SUGGESTION),
                tx.strip(text),
            )
        )
    # A bare clause cannot also match the broad pattern, so the two checks exclude each other.
    if checks.get("broad_except", True) and checks.get("empty_except", True):
        out.append(
            Check(
                "line",
                text.contains("except")
                & text.rlike(BROAD_EXCEPT)
                & F.coalesce(tx.strip(F.col("next_text")) == "pass", F.lit(False)),
                F.lit(EMPTY_MESSAGE),
                F.lit(EMPTY_SUGGESTION),
                tx.strip(text),
                seq=1,
            )
        )
    return out
