"""Unified-diff operators.

A patch lives in one row, so parsing needs no shuffle and no window. Line numbers come from splitting, not from
counting: a hunk is split in front of every line that advances the new file (anything but ``-`` and ``\\``), so
the index of a piece *is* its offset from ``new_start`` and removed lines trail in the piece before the next
advancing line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The hunk header format.
HEADER = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_BEFORE_HEADER = r"\n(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"
_BEFORE_ADVANCING = r"\n(?![-\\])"


def diff_present(files: DataFrame) -> DataFrame:
    """Files that have a patch; a null or empty patch is no diff."""
    return files.filter(F.length("patch") > 0)


def hunk_texts(patch: Column) -> Column:
    """array<string>: each hunk from its header on; text before the first header is dropped."""
    parts = F.split(F.concat(F.lit("\n"), patch), _BEFORE_HEADER, -1)
    return F.filter(parts, lambda _, i: i > 0)


def _number(hunk: Column, group: int) -> Column:
    """A header number; a missing count is 1, an explicit 0 stays 0."""
    text = F.regexp_extract(hunk, "^" + HEADER, group)
    return F.when(text == "", F.lit(1)).otherwise(text.cast("int"))


def _pieces(hunk: Column) -> Column:
    return F.split(hunk, _BEFORE_ADVANCING, -1)


def added_line_numbers(patch: Column) -> Column:
    """array<int>: new-file numbers of the added lines in patch order; empty for a null or empty patch."""
    per_hunk = F.transform(
        hunk_texts(patch),
        lambda h: F.filter(
            F.transform(
                F.array(F.struct(_number(h, 3).alias("start"), _pieces(h).alias("pieces"))),
                lambda s: F.transform(
                    s["pieces"],
                    lambda p, j: F.when((j > 0) & p.startswith("+"), s["start"] + j - 1),
                ),
            )[0],
            lambda n: n.isNotNull(),
        ),
    )
    return F.when(F.length(patch) > 0, F.flatten(per_hunk)).otherwise(F.array().cast("array<int>"))


def diff_hunks(files: DataFrame, keys: list[str]) -> DataFrame:
    """One row per hunk: header numbers and the stripped text after the header."""
    from pullscan.functions.text import strip

    first_line = F.substring_index("hunk", "\n", 1)
    return (
        diff_present(files)
        .select(*keys, F.posexplode(hunk_texts(F.col("patch"))).alias("hunk_no", "hunk"))
        .select(
            *keys,
            "hunk_no",
            _number(F.col("hunk"), 1).alias("old_start"),
            _number(F.col("hunk"), 2).alias("old_count"),
            _number(F.col("hunk"), 3).alias("new_start"),
            _number(F.col("hunk"), 4).alias("new_count"),
            strip(F.regexp_extract(first_line, "(?ds)^" + HEADER + "(.*)$", 5)).alias("header"),
        )
    )


def diff_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """Every hunk line with change type and new-file line number.

    Three stacked generators, no shuffle. ``(hunk_no, piece_no, part_no)`` is the order of the patch.
    """
    raw = F.col("raw")
    advancing = F.col("part_no") == 0
    return (
        diff_present(files)
        .select(*keys, F.posexplode(hunk_texts(F.col("patch"))).alias("hunk_no", "hunk"))
        .select(
            *keys,
            "hunk_no",
            _number(F.col("hunk"), 3).alias("new_start"),
            F.posexplode(_pieces(F.col("hunk"))).alias("piece_no", "piece"),
        )
        .select(
            *keys,
            "hunk_no",
            "new_start",
            "piece_no",
            F.posexplode(F.split("piece", "\n", -1)).alias("part_no", "raw"),
        )
        .filter(~((F.col("piece_no") == 0) & advancing) & ~raw.startswith("\\"))
        .select(
            *keys,
            "hunk_no",
            "piece_no",
            "part_no",
            (F.col("new_start") + F.col("piece_no") - F.when(advancing, 1).otherwise(0)).alias("line_number"),
            F.when(~advancing | raw.startswith("+") | raw.startswith(" "), F.substring(raw, 2, 1 << 30))
            .otherwise(raw)
            .alias("content"),
            F.when(~advancing, "removed")
            .when(raw.startswith("+"), "added")
            .otherwise("context")
            .alias("change_type"),
        )
    )


def hunk_lines(hunk: Column) -> Column:
    """array<struct<line_number, content, change_type>> of one hunk text, in patch order."""

    def of_piece(start, piece, j):
        return F.transform(
            F.filter(
                F.transform(
                    F.split(piece, "\n", -1),
                    lambda raw, k: F.struct(raw.alias("raw"), k.alias("k")),
                ),
                lambda x: ~((j == 0) & (x["k"] == 0)) & ~x["raw"].startswith("\\"),
            ),
            lambda x: F.struct(
                (start + j - F.when(x["k"] == 0, 1).otherwise(0)).alias("line_number"),
                F.when(
                    (x["k"] > 0) | x["raw"].startswith("+") | x["raw"].startswith(" "),
                    F.substring(x["raw"], 2, 1 << 30),
                )
                .otherwise(x["raw"])
                .alias("content"),
                F.when(x["k"] > 0, "removed")
                .when(x["raw"].startswith("+"), "added")
                .otherwise("context")
                .alias("change_type"),
            ),
        )

    return F.transform(
        F.array(_number(hunk, 3)),
        lambda start: F.flatten(F.transform(_pieces(hunk), lambda p, j: of_piece(start, p, j))),
    )[0]


def diff_nested(files: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file: array of hunks, each with its lines. Built inside the row."""
    hunks = F.transform(
        hunk_texts(F.col("patch")),
        lambda h: F.struct(
            _number(h, 1).alias("old_start"),
            _number(h, 2).alias("old_count"),
            _number(h, 3).alias("new_start"),
            _number(h, 4).alias("new_count"),
            hunk_lines(h).alias("lines"),
        ),
    )
    return diff_present(files).select(*keys, hunks.alias("hunks"))


def added_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """All added lines over all hunks."""
    return diff_lines(files, keys).filter(F.col("change_type") == "added").drop("change_type")


def changed_line_numbers(files: DataFrame, keys: list[str]) -> DataFrame:
    """New-file numbers of the added lines, one row per added line."""
    return diff_present(files).select(
        *keys, F.explode(added_line_numbers(F.col("patch"))).alias("line_number")
    )


def added_chunks(files: DataFrame, keys: list[str], min_chunk_size: int = 1) -> DataFrame:
    """Maximal runs of added lines with start, end and joined code.

    Runs are taken over the whole patch: a hunk boundary does not cut, nor do ``\\`` rows. Built inside the row:
    the starts and ends of the runs are zipped, so no window and no shuffle is needed.
    """
    lines = F.flatten(F.transform(hunk_texts(F.col("patch")), hunk_lines))
    flat = diff_present(files).select(*keys, lines.alias("lines"))

    def added_at(i):
        return F.coalesce(F.get(F.col("lines"), i)["change_type"] == "added", F.lit(False))

    runs = flat.select(
        *keys,
        "lines",
        F.filter(
            F.transform("lines", lambda x, i: F.when(added_at(i) & ~added_at(i - 1), i)),
            lambda i: i.isNotNull(),
        ).alias("starts"),
        F.filter(
            F.transform("lines", lambda x, i: F.when(added_at(i) & ~added_at(i + 1), i)),
            lambda i: i.isNotNull(),
        ).alias("ends"),
    )
    sized = F.filter(
        F.arrays_zip("starts", "ends"), lambda r: r["ends"] - r["starts"] + 1 >= F.lit(min_chunk_size)
    )
    chunk = F.transform(
        sized,
        lambda r: F.struct(
            F.get(F.col("lines"), r["starts"])["line_number"].alias("start_line"),
            F.get(F.col("lines"), r["ends"])["line_number"].alias("end_line"),
            (r["ends"] - r["starts"] + 1).alias("n_lines"),
            F.array_join(
                F.transform(
                    F.slice(F.col("lines"), r["starts"] + 1, r["ends"] - r["starts"] + 1),
                    lambda x: x["content"],
                ),
                "\n",
            ).alias("code"),
        ),
    )
    return runs.select(*keys, F.posexplode(chunk).alias("chunk_no", "chunk")).select(
        *keys, "chunk_no", "chunk.start_line", "chunk.end_line", "chunk.n_lines", "chunk.code"
    )
