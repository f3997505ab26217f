"""Code facts over a corpus: functions, classes, imports, module variables, calls, complexity.

Python files go through one Arrow-batched stage that parses the text with the standard ``ast`` module; only the text
column is shipped to Python. Other files, and files that do not parse, get regex facts computed in the JVM. Both
yield the same arrays inside the file's row, so everything after that is relational or row-local.

Where a byte-sliced concrete syntax tree and the declared intent of the facts disagree, the intent wins: decorated
methods and nested classes are listed, decorators are attached to what they decorate, ``from a import b`` keeps
module ``a`` with name ``b``, ``import a, b`` gives two rows, module variables exclude function locals, and source
text is cut by characters.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.functions import text as tx
from pullscan.functions.once import compute_once
from pullscan.operators import pyfacts
from pullscan.rules.checks import CLASS, DEF

FUNCTION_TYPE = (
    "struct<name:string,class_name:string,class_line:int,start_line:int,end_line:int,body_start_line:int,parameters:array<string>,"
    "return_type:string,decorators:array<string>,is_async:boolean,docstring:string,complexity:int,"
    "calls:array<string>>"
)
CLASS_TYPE = (
    "struct<name:string,start_line:int,end_line:int,bases:array<string>,decorators:array<string>,docstring:string,"
    "methods:array<string>>"
)
IMPORT_TYPE = "struct<module:string,names:array<string>,alias:string,line:int,is_from_import:boolean>"
GLOBAL_TYPE = "struct<name:string,line:int>"
FACTS_TYPE = (
    f"struct<functions:array<{FUNCTION_TYPE}>,classes:array<{CLASS_TYPE}>,imports:array<{IMPORT_TYPE}>,"
    f"globals:array<{GLOBAL_TYPE}>>"
)
SYNTAX_TYPE = "struct<ok:boolean,line:int,offset:int,message:string,text:string>"

# The helper travels with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(pyfacts)


def python_facts(content: Column) -> Column:
    """Facts of a text that parses as Python, else null."""
    return F.arrow_udf(pyfacts.facts_batch, FACTS_TYPE)(content)


OUTLINE_TYPE = "struct<functions:array<string>,classes:array<string>,imports:array<string>,score:int>"
OUTLINES_TYPE = f"struct<before:{OUTLINE_TYPE},after:{OUTLINE_TYPE}>"
PAIR_TYPE = f"struct<syntax:{SYNTAX_TYPE},before:{OUTLINE_TYPE},after:{OUTLINE_TYPE}>"


def python_pair(original: Column, refactored: Column, is_python: Column) -> Column:
    """Syntax of the second text and the outlines (names, complexity) of both, in one pass over the pair. No text is executed."""
    return F.arrow_udf(pyfacts.pair_batch, PAIR_TYPE)(original, refactored, is_python)


def python_outlines(original: Column, refactored: Column, is_python: Column) -> Column:
    """The same outlines where no syntax is asked for: no text is compiled either."""
    return F.arrow_udf(pyfacts.outlines_batch, OUTLINES_TYPE)(original, refactored, is_python)


# ---------------------------------------------------------------------------------------------------------
# regex facts (JVM)

_IMPORT = r"(?Ud)^(from[\s\x1C-\x1F]+([^\s\x1C-\x1F]+)[\s\x1C-\x1F]+)?import[\s\x1C-\x1F]+([^\s\x1C-\x1F]+)"
_ASYNC = tx.FLAGS + "^" + tx.WS + "*async" + tx.WS + "+def"


def _not_null(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def regex_facts(lines: Column) -> Column:
    """Facts by pattern per line: names and lines only, every span is one line long."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    functions = _not_null(
        F.transform(
            lines,
            lambda t, i: F.when(
                t.contains("def") & t.rlike(DEF),
                F.struct(
                    F.regexp_extract(t, DEF, 1).alias("name"), none.alias("class_name"), F.lit(None).cast("int").alias("class_line"),
                    (i + 1).alias("start_line"), (i + 1).alias("end_line"), F.lit(0).alias("body_start_line"),
                    empty.alias("parameters"), none.alias("return_type"), empty.alias("decorators"),
                    t.rlike(_ASYNC).alias("is_async"), none.alias("docstring"), F.lit(1).alias("complexity"),
                    empty.alias("calls"),
                ),
            ),
        )
    )
    classes = _not_null(
        F.transform(
            lines,
            lambda t, i: F.when(
                t.contains("class") & t.rlike(CLASS),
                F.struct(
                    F.regexp_extract(t, CLASS, 1).alias("name"), (i + 1).alias("start_line"),
                    (i + 1).alias("end_line"), empty.alias("bases"), empty.alias("decorators"),
                    none.alias("docstring"), empty.alias("methods"),
                ),
            ),
        )
    )

    def import_of(t, i):
        s = tx.strip(t)
        source = F.regexp_extract(s, _IMPORT, 2)
        return F.when(
            t.contains("import") & s.rlike(_IMPORT),
            F.struct(
                F.when(source != "", source).otherwise(F.regexp_extract(s, _IMPORT, 3)).alias("module"),
                empty.alias("names"), none.alias("alias"), (i + 1).alias("line"),
                (source != "").alias("is_from_import"),
            ),
        )

    return F.struct(
        functions.alias("functions"),
        classes.alias("classes"),
        _not_null(F.transform(lines, import_of)).alias("imports"),
        F.array().cast(f"array<{GLOBAL_TYPE}>").alias("globals"),
    ).cast(FACTS_TYPE)


def code_metrics(lines: Column) -> tuple[Column, Column]:
    """``loc`` and ``sloc`` (neither blank nor a comment line)."""
    source = F.filter(lines, lambda t: ~tx.is_blank(t) & ~tx.lstrip(t).startswith("#"))
    return F.size(lines), F.size(source)


def loc_sloc(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    loc, sloc = code_metrics(F.col("lines"))
    return files.select(*keys, tx.split_lines(F.col(content)).alias("lines")).select(
        *keys, loc.alias("loc"), sloc.alias("sloc")
    )


def facts_regex(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return files.select(*keys, tx.split_lines(F.col(content)).alias("lines")).select(
        *keys, regex_facts(F.col("lines")).alias("facts")
    )


def with_facts(files: DataFrame, content: str, name: str, filename: str = "filename") -> DataFrame:
    """Add ``<name>`` (the facts) and ``<name>_source``: ``ast`` for a ``.py`` file that parses, else ``regex``."""
    parsed = python_facts(F.when(tx.path_suffix(F.col(filename)) == ".py", F.col(content)))
    ast, lines = f"{name}_ast", f"{name}_lines"
    return (
        files.withColumn(ast, parsed)
        # The text is split only where the regex facts are needed.
        .withColumn(lines, F.when(F.col(ast).isNull(), tx.split_lines(F.col(content))))
        .withColumn(
            name,
            F.when(F.col(ast).isNotNull(), F.col(ast)).when(F.col(lines).isNotNull(), regex_facts(F.col(lines))),
        )
        .withColumn(f"{name}_source", F.when(F.col(ast).isNotNull(), "ast").otherwise("regex"))
        .drop(ast, lines)
    )


def complexity_score(facts: Column, source: Column) -> Column:
    """Sum over functions and methods; regex facts carry no score."""
    total = F.aggregate(facts["functions"], F.lit(0), lambda acc, f: acc + f["complexity"])
    return F.when(source == "ast", total).otherwise(0)


def code_facts(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per file: facts, their source, line counts and complexity score. Routes each file by extension."""
    loc, sloc = code_metrics(tx.split_lines(F.col(content)))
    facts = compute_once(
        with_facts(files, content, "facts"), [*keys, content, "facts_source"], {"facts": F.col("facts")}
    )
    return facts.select(
        *keys,
        F.col("facts_source").alias("source"),
        "facts",
        loc.alias("loc"),
        sloc.alias("sloc"),
        complexity_score(F.col("facts"), F.col("facts_source")).alias("complexity_score"),
    )


def facts_functions(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.select(*keys, F.inline("facts.functions"))


def facts_classes(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Classes with the names of their methods, which a class has from its own body, so classes of one name stay apart."""
    return facts.select(*keys, F.inline("facts.classes"))


def facts_imports(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.select(*keys, F.inline("facts.imports"))


def facts_globals(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.select(*keys, F.inline("facts.globals"))


def facts_calls(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Call edges: one row per function and distinct called name."""
    return facts.select(*keys, F.explode("facts.functions").alias("f")).select(
        *keys, F.col("f.name").alias("caller"), F.col("f.start_line").alias("line"),
        F.explode("f.calls").alias("callee"),
    )


def complex_functions(facts: DataFrame, keys: list[str], threshold: int = 10) -> DataFrame:
    return facts_functions(facts, keys).filter(F.col("complexity") > threshold)


def long_functions(facts: DataFrame, keys: list[str], threshold: int = 50) -> DataFrame:
    return facts_functions(facts, keys).filter(F.col("end_line") - F.col("start_line") + 1 > threshold)


def _segments(facts: DataFrame, keys: list[str], array: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``starts, names``: the lines at which the covering entry changes, in order, and its name from there on (null: none).

    The first entry of the array that covers a line counts. Made once for each file; nothing but two short arrays goes on from here.
    """
    field = lambda name: F.transform(array, lambda s: s[name])
    spans = {"span_names": field("name"), "first": field("start_line"), "last": field("end_line")}
    slim = compute_once(facts, [*keys, *extra], spans)
    cut = slim.withColumn("cut", F.arrow_udf(pyfacts.segments_batch, "struct<starts:array<int>,names:array<string>>")(*map(F.col, spans)))
    return compute_once(cut, [*keys, *extra], {"starts": F.col("cut.starts"), "names": F.col("cut.names")})


#: Steps of a search by halving: enough for arrays of fewer than 64, and of some millions of entries.
FEW, MANY = [1 << i for i in range(5, -1, -1)], [1 << i for i in range(21, -1, -1)]


def _last_at_or_before(starts: Column, line: Column) -> Column:
    """How many of the sorted starts are at or before a line, by halving."""
    steps = F.when(F.size(starts) < 64, F.array(*map(F.lit, FEW))).otherwise(F.array(*map(F.lit, MANY)))
    reach = lambda n, step: F.coalesce((n + step <= F.size(starts)) & (F.get(starts, n + step - 1) <= line), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(reach(n, step), n + step).otherwise(n))


def _at_line(positions: DataFrame, facts: DataFrame, keys: list[str], array: str, name: str) -> DataFrame:
    """First entry of the file's array that covers the line, for any positions. An equi join on the file with its segments: no
    interval join, and no pairs of positions and spans are ever produced."""
    segments = _segments(facts, keys, array)
    hit = F.get("names", _last_at_or_before(F.col("starts"), F.col("line")) - 1)
    return positions.join(segments, keys, "left").select(*positions.columns, hit.alias(name))


def _of_lines(facts: DataFrame, keys: list[str], array: str, name: str) -> DataFrame:
    """The same for every line of the files themselves, from the row of the file: its segments written out, without a join."""
    segments = _segments(facts, keys, array, ("loc",))
    n, none = F.size("starts"), F.lit(None).cast("string")
    after = F.transform(
        "starts",
        lambda a, k: F.struct(a.alias("first"), (F.coalesce(F.get("starts", k + 1), F.col("loc") + 1) - 1).alias("last"), F.get("names", k).alias("name")),
    )
    before = F.struct(F.lit(1).alias("first"), F.when(n > 0, F.get("starts", F.lit(0)) - 1).otherwise(F.col("loc")).alias("last"), none.alias("name"))
    runs = segments.select(*keys, F.inline(F.filter(F.concat(F.array(before), after), lambda r: r["first"] <= r["last"])))
    return runs.select(*keys, F.explode(F.sequence("first", "last")).alias("line"), F.col("name").alias(name))


def function_at_line(positions: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Functions come before methods in the array, so they win."""
    return _at_line(positions, facts, keys, "facts.functions", "function_name")


def class_at_line(positions: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    return _at_line(positions, facts, keys, "facts.classes", "class_name")


def function_of_lines(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Every line of every file with the function around it."""
    return _of_lines(facts, keys, "facts.functions", "function_name")


def class_of_lines(facts: DataFrame, keys: list[str]) -> DataFrame:
    return _of_lines(facts, keys, "facts.classes", "class_name")
