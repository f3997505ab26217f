"""Source lines, function spans and the review units that rules run on.

A file's text is one row. Everything that needs the order of its lines is computed inside that row with array
functions, so a scan turns into rule input without any shuffle, window or self-join, and one large file cannot
drag others into its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.functions import text as tx
from pullscan.functions.once import compute_once, let
from pullscan.operators.diff import added_line_numbers
from pullscan.rules.checks import DEF


def source_lines(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per line with its number from 1, its indent and whether it is blank."""
    return files.select(*keys, F.posexplode(tx.split_lines(F.col(content))).alias("pos", "text")).select(
        *keys,
        (F.col("pos") + 1).alias("line"),
        "text",
        tx.indent_of(F.col("text")).alias("indent"),
        tx.is_blank(F.col("text")).alias("is_blank"),
    )


def _non_blank(lines: Column) -> Column:
    """array<struct<no, indent, name>> of the non-blank lines; name is null unless the line starts a function."""
    return F.filter(
        F.transform(
            lines,
            lambda t, i: F.when(
                ~tx.is_blank(t),
                F.struct(
                    (i + 1).alias("no"),
                    tx.indent_of(t).alias("indent"),
                    F.when(t.contains("def") & t.rlike(DEF), F.regexp_extract(t, DEF, 1)).alias("name"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )


def _spans(non_blank: Column, n_lines: Column) -> Column:
    """array<struct<start, stop, end, indent, name>> sorted by start.

    For one indent level keep the non-blank lines indented no deeper. Every function start of that level is among
    them, and the line that stops it is simply the next one kept. One pass per level that occurs in the file.
    """
    indexed = F.transform(
        non_blank, lambda x, i: F.struct(x["no"].alias("no"), x["indent"].alias("indent"), x["name"].alias("name"), i.alias("i"))
    )
    levels = F.array_distinct(
        F.transform(F.filter(non_blank, lambda x: x["name"].isNotNull()), lambda x: x["indent"])
    )

    def of_level(level):
        return F.transform(
            F.array(F.filter(indexed, lambda x: x["indent"] <= level)),
            lambda kept: F.filter(
                F.transform(
                    kept,
                    lambda x, k: F.when(
                        x["name"].isNotNull() & (x["indent"] == level),
                        F.struct(
                            x["no"].alias("start"),
                            F.coalesce(F.get(kept, k + 1)["no"], n_lines + 1).alias("stop"),
                            F.get(
                                non_blank, F.coalesce(F.get(kept, k + 1)["i"], F.size(non_blank)) - 1
                            )["no"].alias("end"),
                            level.alias("indent"),
                            x["name"].alias("name"),
                        ),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
        )[0]

    return F.sort_array(F.flatten(F.transform(levels, of_level)))


def _running(values: Column) -> Column:
    """struct<values, block, upto>: numbers of the lines, and their sum before each block of ``block`` lines.

    Blocks grow with the square root of the number of lines, so the sums before them take no longer than reading the lines.
    """
    block = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(values)) / 2).cast("int"))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def sums(b):
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / b).cast("int")), lambda k: total(F.slice(values, k * b + 1, b))
        )
        upto = let(blocks, lambda each: F.transform(F.sequence(F.lit(0), F.size(each)), lambda k: total(F.slice(each, F.lit(1), k))))
        return F.struct(values.alias("values"), b.alias("block"), upto.alias("upto"))

    return let(block, sums)


def _sum_between(running: Column, after: Column, last: Column) -> Column:
    """Sum over the lines behind line ``after`` up to line ``last``: a difference of two running sums."""

    def upto(line):
        block = F.floor(line / running["block"]).cast("int")
        rest = F.slice(running["values"], block * running["block"] + 1, line % running["block"])
        return F.get(running["upto"], block) + F.aggregate(rest, F.lit(0), lambda a, x: a + x)

    return upto(last) - upto(after)


FUNCTIONS = (
    "array<struct<start:int,stop:int,end:int,indent:int,name:string,complexity:int,fn_lines:int,fn_blank:int,fn_comment:int>>"
)


def with_functions(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``lines`` and ``functions``: array<struct<start, stop, end, indent, name, complexity, fn_lines, fn_blank,
    fn_comment>>. The span ends at the last non-blank line before the stop line; ``fn_*`` count the lines after the
    start and before the stop.

    Each line is matched once, however deep the functions around it are nested: a function is a difference of running sums.
    """
    with_lines = files.withColumn("lines", tx.split_lines(F.col(content)))
    with_nb = with_lines.withColumn(
        "non_blank",
        F.when(F.col(content).contains("def"), _non_blank(F.col("lines"))),
    )
    with_spans = with_nb.withColumn(
        "spans",
        F.when(F.col("non_blank").isNotNull(), _spans(F.col("non_blank"), F.size("lines"))),
    )
    counted = F.size("spans") > 0

    def running(of):
        return F.when(counted, let(F.transform("lines", of), _running))

    with_sums = with_spans.withColumns(
        {
            "hits": running(tx.line_complexity),
            "blanks": running(lambda t: tx.is_blank(t).cast("int")),
            "comments": running(lambda t: tx.lstrip(t).startswith("#").cast("int")),
        }
    )

    def describe(s):
        return F.struct(
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            s["end"].alias("end"),
            s["indent"].alias("indent"),
            s["name"].alias("name"),
            (F.lit(1) + _sum_between(F.col("hits"), s["start"] - 1, s["end"])).alias("complexity"),
            (s["stop"] - s["start"] - 1).alias("fn_lines"),
            _sum_between(F.col("blanks"), s["start"], s["stop"] - 1).alias("fn_blank"),
            _sum_between(F.col("comments"), s["start"], s["stop"] - 1).alias("fn_comment"),
        )

    return with_sums.withColumn(
        "functions", F.coalesce(F.when(counted, F.transform("spans", describe)), F.array().cast(FUNCTIONS))
    ).drop("non_blank", "spans", "hits", "blanks", "comments")


def function_spans(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per ``def`` with name, first and last line and indent."""
    found = compute_once(with_functions(files, content), keys, {"functions": F.col("functions")})
    return found.select(*keys, F.explode("functions").alias("f")).select(
        *keys,
        F.col("f.name").alias("name"),
        F.col("f.start").alias("start_line"),
        F.col("f.end").alias("end_line"),
        F.col("f.indent").alias("indent"),
        F.col("f.complexity").alias("complexity"),
        F.col("f.fn_lines").alias("fn_lines"),
        F.col("f.fn_blank").alias("fn_blank"),
        F.col("f.fn_comment").alias("fn_comment"),
    )


def changed_line_gate(files: DataFrame, keys: list[str]) -> DataFrame:
    """The lines a line rule may look at: the added lines that exist in the file, or every line when the patch adds
    none. Looks lines up by number, so unchanged lines are never expanded."""
    return review_units(files, keys, functions=False).select(*keys, "line", "text", "next_text")


def review_units(
    files: DataFrame, keys: list[str], lines: bool = True, functions: bool = True, content: str = "content"
) -> DataFrame:
    """One row per unit: gated lines and whole-file functions, from a single pass over the files.

    ``patch`` may be absent, which scans whole files. Files with null or empty content give no units.
    """
    base = files.filter(F.length(content) > 0)
    patch = F.col("patch") if "patch" in files.columns else F.lit(None).cast("string")
    base = base.withColumn("added", added_line_numbers(patch))
    base = with_functions(base, content) if functions else base.withColumn("lines", tx.split_lines(F.col(content)))
    n = F.size("lines")
    wanted = F.when(
        F.size("added") > 0,
        F.sort_array(F.array_distinct(F.filter("added", lambda a: (a >= 1) & (a <= n)))),
    ).otherwise(F.sequence(F.lit(1), n))
    base = base.withColumn("wanted", wanted) if lines else base
    no_str, no_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    line_units = lambda: F.transform(
        "wanted",
        lambda i: F.struct(
            F.lit("line").alias("unit"),
            i.alias("line"),
            F.get(F.col("lines"), i - 1).alias("text"),
            F.get(F.col("lines"), i).alias("next_text"),
            no_str.alias("fn_name"),
            no_int.alias("fn_complexity"),
            no_int.alias("fn_lines"),
            no_int.alias("fn_blank"),
            no_int.alias("fn_comment"),
        ),
    )
    function_units = lambda: F.transform(
        "functions",
        lambda f: F.struct(
            F.lit("function").alias("unit"),
            f["start"].alias("line"),
            no_str.alias("text"),
            no_str.alias("next_text"),
            f["name"].alias("fn_name"),
            f["complexity"].alias("fn_complexity"),
            f["fn_lines"].alias("fn_lines"),
            f["fn_blank"].alias("fn_blank"),
            f["fn_comment"].alias("fn_comment"),
        ),
    )
    if lines and functions:
        units = F.concat(line_units(), function_units())
    else:
        units = line_units() if lines else function_units()
    return base.select(*keys, F.inline(units))
