"""Column helpers whose results equal Python's ``str`` / ``re`` behaviour on Unicode text.

Spark's ``trim`` strips only blanks and Java's ``\\w`` / ``\\s`` are ASCII by default, so every helper here
either passes the full whitespace set to the built-in trim or switches the Java pattern to Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pullscan.functions.pattern import translate

# The characters for which Python's str.isspace() is true.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same sets as Java regex classes (used with the U flag).
WS = r"[\s\x1C-\x1F]"
WORD = r"[\p{L}\p{N}_]"
# Around a literal word: not part of a longer word on either side.
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"
# U: Unicode classes, d: only \n ends a line (as in Python).
FLAGS = "(?Ud)"
FLAGS_NOCASE = "(?iUd)"


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITESPACE))


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITESPACE))


def indent_of(line: Column) -> Column:
    """Number of leading whitespace characters."""
    return F.length(line) - F.length(lstrip(line))


def is_blank(line: Column) -> Column:
    return lstrip(line) == ""


def split_lines(text: Column) -> Column:
    """``text.split("\\n")``: trailing empty lines are kept."""
    return F.split(text, "\n", -1)


def prefix(col: Column, n: int) -> Column:
    """``text[:n]`` in code points."""
    return F.substring(col, 1, n)


def text_caps(col: Column) -> dict[str, Column]:
    """The fixed prefix lengths used across comments, prompts, summaries and short commit ids."""
    return {f"cap_{n}": prefix(col, n) for n in (7, 100, 200, 500, 2000)}


def file_extension(path: Column) -> Column:
    """Text from the last dot of the whole path, '' when there is no dot; case is kept."""
    return F.when(path.contains("."), F.concat(F.lit("."), F.substring_index(path, ".", -1))).otherwise(F.lit(""))


def path_suffix(path: Column) -> Column:
    """``pathlib.Path.suffix`` lower-cased: extension of the last path component, '' for dot-files."""
    base = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(base, r"(?d)^.+(\.[^.]+)$", 1))


def path_stem(path: Column) -> Column:
    """``pathlib.Path.stem``."""
    base = F.substring_index(path, "/", -1)
    return F.when(base.rlike(r"(?d)^.+\.[^.]+$"), F.regexp_replace(base, r"(?d)\.[^.]+$", "")).otherwise(base)


def path_parent(path: Column) -> Column:
    """``str(pathlib.Path.parent)``: '.' when there is no directory."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?ds)^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


# Naming convention patterns.
CONVENTIONS = {
    "snake_case": r"^[a-z][a-z0-9_]*$",
    "PascalCase": r"^[A-Z][a-zA-Z0-9]*$",
    "UPPER_SNAKE_CASE": r"^[A-Z][A-Z0-9_]*$",
    "camelCase": r"^[a-z][a-zA-Z0-9]*$",
}


def name_matches(name: Column, convention: str) -> Column:
    """True when the name follows the convention; unknown conventions accept every name."""
    pattern = CONVENTIONS.get(convention)
    return F.lit(True) if pattern is None else name.rlike(pattern)


def name_convert(name: Column, convention: str) -> Column:
    """Split a name into words and join them again in the convention; other conventions leave it as it is."""
    words = F.transform(
        F.filter(F.split(name, r"(?U)[_\s\x1C-\x1F]+|(?<=[a-z])(?=[A-Z])", -1), lambda w: w != ""),
        lambda w: F.lower(w),
    )
    if convention == "snake_case":
        return F.array_join(words, "_")
    if convention == "UPPER_SNAKE_CASE":
        return F.upper(F.array_join(words, "_"))
    if convention == "PascalCase":
        capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
        return F.array_join(capital, "")
    return name


def redact_quotes(line: Column) -> Column:
    """Replace the inside of every quoted run that opens and closes with the same quote."""
    return F.regexp_replace(line, r"""(['"])([^'"]+)\1""", "$1[REDACTED]$1")


# Words that add one to the complexity of a function.
COMPLEXITY_WORDS = ("if", "elif", "for", "while", "and", "or", "except")
_COMPLEXITY = FLAGS + NOT_AFTER_WORD + "(?:" + "|".join(COMPLEXITY_WORDS) + ")" + NOT_BEFORE_WORD


def line_complexity(text: Column) -> Column:
    """Whole-word keyword hits, strings and comments included."""
    return F.regexp_count(text, F.lit(_COMPLEXITY))


def infer_category(description: Column) -> Column:
    """Keyword cascade from a free-text description to a violation category."""
    d = F.lower(description)
    # Keyword lists in order of precedence.
    security = ("security", "vulnerability", "injection", "xss", "secret")
    style = ("style", "naming", "format", "indent")
    quality = ("complexity", "performance", "memory", "efficiency")

    def any_of(words):
        hit = d.contains(words[0])
        for w in words[1:]:
            hit = hit | d.contains(w)
        return hit

    return (
        F.when(any_of(security), "security")
        .when(any_of(style), "style")
        .when(any_of(quality), "quality")
        .otherwise("best_practices")
    )


def python_regex(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern as the Java pattern that finds the same."""
    return translate(pattern, ignore_case).java


def rlike_any(col: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """True when any pattern is found; false for an empty list. Stops at the first hit."""
    hit: Column | None = None
    for p in patterns:
        one = col.rlike(python_regex(p, ignore_case))
        hit = one if hit is None else hit | one
    return F.lit(False) if hit is None else hit
