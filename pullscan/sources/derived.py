"""Review tables derived from the given parquet tables.

Every row of ``documents`` becomes one changed file: its sentences become source lines by a fixed recipe
(``FIXTURES.md``). The derivation is row-local, so it reads whole texts and adds no shuffle. A third of all files
belongs to pull request 1, which keeps a hot pull request in every test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pullscan.functions.once import compute_once

# Line text by residue, with a form feed inside a line and two findings on one. Placeholders: {q} sentence, {n} line number, {s} residue.
LINE_RECIPE = """CASE
 WHEN {s} < 4 THEN 'def get_item_' || {n} || '(x):'
 WHEN {s} = 4 THEN 'def GetItem' || {n} || '(x):'
 WHEN {s} = 5 THEN 'class order_item_' || {n} || '(Base):'
 WHEN {s} = 6 THEN 'class OrderItem:'
 WHEN {s} = 7 THEN 'import os'
 WHEN {s} < 10 THEN '    password = "pw' || {n} || '"'
 WHEN {s} = 10 THEN '    secret = "s' || {n} || '" if os.environ else None'
 WHEN {s} < 13 THEN '    q = f"SELECT * FROM t WHERE id = {{x}}"'
 WHEN {s} < 15 THEN '    except:'
 WHEN {s} < 18 THEN '    except Exception:'
 WHEN {s} < 48 THEN '        pass'
 WHEN {s} < 58 THEN '    if a and b or c:'
 WHEN {s} < 68 THEN '        for i in range(' || {n} || '):'
 WHEN {s} < 76 THEN ''
 WHEN {s} < 81 THEN '    # note ' || {q}
 WHEN {s} < 84 THEN '    v = 1  # ' || repeat('x', 120)
 WHEN {s} = 84 THEN '    u = "https://example.org/' || repeat('y', 110) || '"'
 WHEN {s} = 85 THEN 'from pkg import ' || repeat('z', 120)
 WHEN {s} < 90 THEN '    def inner_' || {n} || '(self):'
 WHEN {s} = 90 THEN '    async def ShoutLoud' || {n} || '(self):'
 WHEN {s} = 91 THEN '    y' || {n} || ' = 1' || chr(12)
 WHEN {s} = 92 THEN '    password = "a"; q = f"SELECT * FROM t WHERE id = {{x}}"'
 ELSE '    x' || {n} || ' = "' || {q} || '"' END"""
RESIDUE = "(({f} * 13 + {n} * 29 + length({q}) * 7) % 200)"

FILENAME = """CASE
 WHEN {f} % 13 = 0 THEN 'web/s' || {f} || '.min.js'
 WHEN {f} % 17 = 0 THEN 'docs/s' || {f} || '.md'
 WHEN {f} % 19 = 0 THEN 'Makefile' || {f}
 WHEN {f} % 5 = 2 THEN 'lib/core/m' || {f} || '.ts'
 ELSE 'src/s' || {f} || '.py' END"""
PR_NUMBER = "CASE WHEN {f} % 3 = 0 THEN 1 ELSE 2 + CAST(floor({f} / 5) AS BIGINT) END"
STATUS = "CASE WHEN {f} % 11 = 0 THEN 'removed' WHEN {f} % 4 = 1 THEN 'added' ELSE 'modified' END"
PATCH_MARK = """CASE WHEN {f} % 10 <> 9 AND {n} % 21 IN (0, 1, 2, 5, 9, 10) THEN '+'
 WHEN {n} % 21 IN (13, 14) THEN '-' ELSE ' ' END"""
HUNK = 42


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task of a spread table, so that a task is as small on a large table as on a small one.
ROWS_OF_A_TASK = 2000


def spread(df: DataFrame, small: bool = True) -> DataFrame:
    """Rows dealt to all cores, at every size alike: the given tables can be one split each, the tables they stand for are not.
    Tasks grow in number with the table; its rows are counted from the footers of its files. Without ``small`` a table whose splits are
    many and even stays as it is: it would be moved, and written to disk, only to be in smaller tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    if not small and len(rows) >= 3 * cores and max(rows) * len(rows) <= 1.5 * sum(rows):
        return df
    return df.repartition(_tasks(df, sum(rows)))


def _tasks(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_OF_A_TASK))


def _sentences(spark: SparkSession, sf_dir: str, small: bool = True, wanted: DataFrame | None = None) -> DataFrame:
    """``wanted``: ``file_ord`` of the documents to be read; they meet it as they are, before anything is made of them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    if wanted is None:
        d = spread(docs, small)
    else:
        some = docs.join(wanted.select(F.col("file_ord").alias("doc_id")), "doc_id", "left_semi")
        d = some.repartition(_tasks(docs, docs.count()))
    return d.select(F.col("doc_id").alias("f"), F.split("text", "[.\n]", -1).alias("sentences"))


def _lines() -> Column:
    residue = RESIDUE.format(f="f", n="(i + 1)", q="q")
    recipe = LINE_RECIPE.format(q="x.q", n="x.n", s="x.s")
    return F.expr(
        f"transform(transform(sentences, (q, i) -> struct(q, i + 1 AS n, {residue} AS s)), x -> {recipe})"
    )


def _patch(lines: Column) -> Column:
    mark = PATCH_MARK.format(f="f", n="(i + 1)")
    marked = F.expr(f"transform(src, (t, i) -> struct({mark} AS p, t))")

    def hunk(h):
        first = (h * HUNK + 1).cast("string")

        def text(rows):
            return F.concat(
                F.lit("@@ -"), first, F.lit(","),
                F.size(F.filter(rows, lambda r: r["p"] != "+")).cast("string"),
                F.lit(" +"), first, F.lit(","),
                F.size(F.filter(rows, lambda r: r["p"] != "-")).cast("string"),
                F.lit(" @@ ctx "), h.cast("string"), F.lit("\n"),
                F.array_join(F.transform(rows, lambda r: F.concat(r["p"], r["t"])), "\n"),
            )

        return F.transform(F.array(F.slice(F.col("marked"), h * HUNK + 1, F.lit(HUNK))), text)[0]

    hunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("marked") - 1) / HUNK).cast("int")), hunk)
    return marked, F.concat(F.array_join(hunks, "\n"), F.lit("\n\\ No newline at end of file"))


def source_files(spark: SparkSession, sf_dir: str, patch: bool = True, content: bool = True) -> DataFrame:
    """``repo, pr_number, file_ord, filename, status, additions, deletions, patch, content`` with the text of every
    file, before any gate or join. ``file_ord`` is the document id. Leave out ``patch`` (with its counts) or
    ``content`` where only the other is read."""
    base = compute_once(_sentences(spark, sf_dir, small=False), ["f"], {"src": _lines()})
    made = {}
    if patch:
        marked, text = _patch(F.col("src"))
        base = base.withColumn("marked", marked)
        count = lambda m: F.size(F.filter("marked", lambda r: r["p"] == m))
        made = {"additions": count("+"), "deletions": count("-"), "patch": F.when(F.col("f") % 23 != 0, text)}
    if content:
        made["content"] = F.array_join("src", "\n")
    return compute_once(base, ["f"], made).select(*_keys(), *made)


def _keys() -> list[Column]:
    pr = F.expr(PR_NUMBER.format(f="f"))
    return [
        repo_of(pr).alias("repo"),
        pr.alias("pr_number"),
        F.col("f").alias("file_ord"),
        F.expr(FILENAME.format(f="f")).alias("filename"),
        F.expr(STATUS.format(f="f")).alias("status"),
    ]


def repo_of(pr: Column) -> Column:
    return F.concat(F.lit("org/r"), (pr % 5).cast("string"))


def head_of(pr: Column) -> Column:
    return F.concat(F.lit("feature/"), pr.cast("string"))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pull request per customer; most have no files."""
    pr = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        repo_of(pr).alias("repo"),
        pr.alias("pr_number"),
        F.concat(F.lit("Change "), F.col("c_name")).alias("title"),
        F.when(pr % 2 != 0, F.col("c_mktsegment")).alias("body"),
        F.lit("main").alias("base_branch"),
        head_of(pr).alias("head_branch"),
        F.col("c_name").alias("author"),
        F.col("c_nationkey").alias("commits_count"),
    )


def file_changes(spark: SparkSession, sf_dir: str, patch: bool = True) -> DataFrame:
    """One per document, with the head branch of its pull request. Leave out ``patch`` (with its counts) where it is not read: no text is."""
    files = source_files(spark, sf_dir, content=False) if patch else source_files_keys(spark, sf_dir)
    return files.withColumn("head_branch", head_of(F.col("pr_number")))


def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File texts at the head branch (missing for every 31st) and at the last commit, where the first line is gone
    (missing for every 37th)."""
    src = source_files(spark, sf_dir, patch=False).select("repo", "pr_number", "file_ord", F.col("filename").alias("path"), "content")
    f, pr = F.col("file_ord"), F.col("pr_number")
    newline = F.locate("\n", F.col("content"))
    older = F.when(newline > 0, F.substring(F.col("content"), newline + 1, F.length("content"))).otherwise("")
    versions = F.array(
        F.when(
            f % 31 != 0,
            F.struct(head_of(pr).alias("ref"), F.md5(F.concat(F.lit("h"), f.cast("string"))).alias("sha"),
                     F.col("content").alias("content")),
        ),
        F.when(
            f % 37 != 0,
            F.struct(F.concat(F.lit("base/"), pr.cast("string")).alias("ref"),
                     F.md5(F.concat(F.lit("b"), f.cast("string"))).alias("sha"), older.alias("content")),
        ),
    )
    return src.select("repo", "path", F.explode(F.array_compact(versions)).alias("v")).select(
        "repo", "path", "v.ref", "v.sha", "v.content"
    )


def pr_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per order; ``pr_number`` is the customer."""
    pr = F.col("o_custkey")
    return read_table(spark, sf_dir, "orders").select(
        repo_of(pr).alias("repo"),
        pr.alias("pr_number"),
        F.col("o_orderkey").alias("commit_ord"),
        F.md5(F.col("o_orderkey").cast("string")).alias("sha"),
    )


def repo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of each repository: sources, tests in three places, and a virtual environment to be skipped."""
    s = source_files_keys(spark, sf_dir)
    f = F.col("file_ord")
    num = f.cast("string")
    paths = F.array(
        F.col("filename"),
        F.when(f % 3 == 0, F.concat(F.lit("tests/test_s"), num, F.lit(".py"))),
        F.when(f % 5 == 0, F.concat(F.lit("s"), num, F.lit("_test.py"))),
        F.when(f % 5 == 2, F.concat(F.lit("tests/lib/core/test_m"), num, F.lit(".py"))),
        F.when(f % 7 == 0, F.concat(F.lit(".venv/test_x"), num, F.lit(".py"))),
        F.when(f % 100 == 0, F.lit("requirements.txt")),
    )
    return s.select("repo", F.explode(F.array_compact(paths)).alias("path"))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every ``requirements.txt`` of the trees; every other one names the test framework."""
    s = source_files_keys(spark, sf_dir).filter("file_ord % 100 = 0")
    text = F.when(F.col("file_ord") % 200 == 0, "numpy\nPyTest>=8\n").otherwise("requests==2\n")
    return s.select("repo", text.alias("content"))


def generated_comments(violations: DataFrame) -> DataFrame:
    """A written comment for every second critical or error finding, by the key its prompt carried."""
    some = violations.filter(F.col("severity").isin("critical", "error") & (F.col("line") % 2 == 0))
    body = F.concat(F.lit("Please see "), F.col("rule_id"), F.lit(" in line "), F.col("line").cast("string"), F.lit(", finding "), F.col("seq").cast("string"))
    return some.select("repo", "pr_number", "file", "line", "rule_id", "rule_ord", "seq", body.alias("generated_body"))


def source_files_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and status only; the scan reads nothing but the document ids."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("f")).select(*_keys())


# Test log layouts by order key; a run that timed out has printed counts before. {k} order key, {a} {b} {c} small numbers from it.
CI_STDOUT = """CASE
 WHEN {k} % 6 = 0 THEN 'tests/test_a.py::test_' || {k} || ' PASSED' || chr(10) || 'tests/test_b.py::TestB::test_x FAILED'
   || chr(10) || 'TOTAL     ' || {k} || '    ' || {a} || '    ' || ({k} % 101) || '%' || chr(10)
   || '=== ' || {a} || ' passed, ' || {b} || ' failed, ' || {c} || ' error in ' || {b} || '.5s ==='
 WHEN {k} % 6 = 1 THEN 'tests/test_c.py::test_y PASSED' || chr(10) || '=== ' || {a} || ' passed in ' || {c} || '.25s ==='
 WHEN {k} % 6 = 2 THEN 'tests/test_d.py::test_z ERROR  tests/test_e.py::test_w SKIPPED' || chr(10)
   || '=== ' || {b} || ' failed, ' || {a} || ' passed in ' || {a} || 's ==='
 WHEN {k} % 6 = 3 THEN 'tests/test_f.py::test_v ' || chr(10) || '=== ' || {a} || ' passed, 1 failed in 9s ===' ELSE 'no tests ran' END"""
CI_STDERR = """CASE
 WHEN {k} % 6 = 3 THEN 'Test execution timed out after 300 seconds'
 WHEN {k} % 6 = 4 THEN 'Ran ' || {a} || ' tests' || chr(10) || 'FAILED (errors=1, failures=' || {b} || ')'
 WHEN {k} % 6 = 5 THEN 'OK (tests=' || {a} || ')' ELSE '' END"""


def ci_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test run per order."""
    args = {"k": "o_orderkey", "a": "(o_orderkey % 17)", "b": "(o_orderkey % 5)", "c": "(o_orderkey % 3)"}
    k = F.col("o_orderkey")
    pr = F.col("o_custkey")
    return read_table(spark, sf_dir, "orders").select(
        repo_of(pr).alias("repo"),
        pr.alias("pr_number"),
        k.alias("run_id"),
        F.when(k % 6 >= 4, "unittest").otherwise("pytest").alias("tool"),
        F.when((k % 6 == 1) | (k % 6 == 5), 0).otherwise(1).alias("returncode"),
        (k % 6 == 3).alias("timed_out"),
        F.expr(CI_STDOUT.format(**args)).alias("stdout"),
        F.expr(CI_STDERR.format(**args)).alias("stderr"),
    )


# Model answers by event id. {k} event id, {t} event type. Some have a key twice.
ANSWER_JSON = """'{{' || CASE WHEN {k} % 7 = 0 THEN '"summary": "first", ' ELSE '' END || '"issues": [{{"severity": "' || {t} || '", "line": ' || ({k} % 9) || ', "description": "Possible '
 || CASE WHEN {k} % 3 = 0 THEN 'SQL injection' WHEN {k} % 3 = 1 THEN 'naming problem' ELSE 'memory use' END
 || '", "suggestion": "fix ' || {k} || '"}}], "summary": "s' || {k} || '"}}'"""
ANSWER = """CASE {k} % 4 WHEN 0 THEN {json}
 WHEN 1 THEN 'Here you go:' || chr(10) || '```json' || chr(10) || {json} || chr(10) || '```' || chr(10) || 'bye'
 WHEN 2 THEN 'The answer is ' || {json} || ' as asked'
 ELSE 'I cannot answer number ' || {k} || repeat(' sorry', 120) END"""


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw model response per event."""
    json = ANSWER_JSON.format(k="event_id", t="event_type")
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("answer_id"),
        F.expr(ANSWER.format(k="event_id", json=json)).alias("response"),
    )


# Severities a chunk answer reports; two of them are outside the vocabulary.
CHUNK_SEVERITY = "CASE {k} % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'Critical' WHEN 2 THEN 'info' WHEN 3 THEN 'click' ELSE 'high' END"
CHUNK_KEY = "({f} * 31 + {start})"


def chunk_answers(chunks: DataFrame) -> DataFrame:
    """One raw model response per added chunk."""
    k = CHUNK_KEY.format(f="file_ord", start="start_line")
    json = ANSWER_JSON.format(k=k, t=CHUNK_SEVERITY.format(k=k).join(("(", ")")))
    return chunks.select(
        "repo", "pr_number", "filename", "start_line", F.expr(ANSWER.format(k=k, json=json)).alias("response")
    )


EQUIVALENCE = """CASE WHEN {k} % 5 = 4 THEN 'cannot tell' ELSE
 '{{"equivalent": ' || CASE WHEN {k} % 3 = 0 THEN 'false' ELSE 'true' END || ', "confidence": 0.'
 || ({k} % 10) || ', "differences": [], "assessment": "a' || {k} || '"}}' END"""


def equivalence_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One semantic-comparison answer per event."""
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("answer_id"),
        F.expr(EQUIVALENCE.format(k="event_id")).alias("response"),
    )


def pair_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One semantic-comparison answer per rewritten module, but for every seventh; ``repo, pr_number, file_ord, filename, response``."""
    pr = F.expr(PR_NUMBER.format(f="doc_id"))
    return read_table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0").select(
        repo_of(pr).alias("repo"), pr.alias("pr_number"), F.col("doc_id").alias("file_ord"),
        F.expr(FILENAME.format(f="doc_id")).alias("filename"), F.expr(EQUIVALENCE.format(k="doc_id")).alias("response"),
    )


# A model's rewrite of a file, by document id.
REWRITE = """CASE {k} % 3 WHEN 0 THEN '{{"refactored_code": "value_' || {k} || ' = 1", "explanation": "e' || {k} || '"}}'
 WHEN 1 THEN '{{"refactored_code": "value_' || {k} || ' = os.environ"}}' ELSE 'sorry' END"""


def rewrite_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw rewrite answer per changed file."""
    pr = F.expr(PR_NUMBER.format(f="doc_id"))
    return read_table(spark, sf_dir, "documents").select(
        repo_of(pr).alias("repo"), pr.alias("pr_number"), F.expr(FILENAME.format(f="doc_id")).alias("filename"),
        F.expr(REWRITE.format(k="doc_id")).alias("response"),
    )


# ---------------------------------------------------------------------------------------------------------
# valid Python modules for the syntax-tree facts

# Module head and six eight-line blocks; classes of a file share names, and a comment holds a form feed. {f} file, {n} block number, {q} cleaned sentence.
MODULE_HEAD = (
    "'\"\"\"Module ' || {f} || '.\"\"\"'",
    "'import os'",
    "'import json as js'",
    "'from pkg.mod' || ({f} % 7) || ' import alpha, beta as b' || ({f} % 3)",
)
BLOCKS = (
    (
        "'def fn_' || {n} || '(a, b=1, *args, **kwargs):'",
        "'    \"\"\"Doc ' || {n} || '.\"\"\"'",
        "'    if a and b:'",
        "'        return helper(a)'",
        "'    elif b:'",
        "'        return [x for x in args]'",
        "'    return None'",
        "''",
    ),
    (
        "'@cached'",
        "'async def co_' || {n} || '(x: int, y: str = \"s\") -> int:'",
        "'    async with ctx() as c:'",
        "'        for i in range(x):'",
        "'            c.push(i)'",
        "'    assert x, \"m\"'",
        "'    return x if y else 0'",
        "''",
    ),
    (
        "'class Thing' || ({n} % 7) || '(Base, mixins.Mix):'",
        "'    \"\"\"Thing ' || {n} || '.\"\"\"'",
        "'    attr_' || {n} || ' = 1'",
        "'    def run(self, k):'",
        "'        while k or self.go():'",
        "'            k -= 1'",
        "'    @property'",
        "'    def size(self): return len(self.items)'",
    ),
    (
        "'LIMIT_' || {n} || ' = ' || {n}",
        "'_hidden_' || {n} || ' = 2'",
        "'typed_' || {n} || ': int = 3'",
        "'a_' || {n} || ' = b_' || {n} || ' = 4'",
        "'LIMIT_' || {n} || ' += 1'",
        "'# validate ' || {n}",
        "'try: import fast_' || {n}",
        "'except ImportError: fast_' || {n} || ' = None'",
    ),
    (
        "'def outer_' || {n} || '(q):'",
        "'    def inner(z):'",
        "'        return z * 2'",
        "'    match q:'",
        "'        case 0: return inner(q)'",
        "'        case _: logger.info(q)'",
        "'    return sum(v for v in q)'",
        "''",
    ),
    (
        "'TEXT_' || {n} || ' = \"' || {q} || '\"'",
        "'# note' || chr(12) || 'y = 2'",
        "'def say_' || {n} || '(): print(TEXT_' || {n} || ')'",
        "''",
        "'with open(\"p\") as fh, lock: pass'",
        "''",
        "'for _i in (): pass'",
        "''",
    ),
)
BLOCK_KIND = "(({f} + {n}) % 6)"


def _module(where: str) -> Column:
    """The module lines as one text; ``where`` keeps blocks by their number."""
    # Lines that meet in two literals are one literal, so that a block is put together of few parts.
    joined = lambda lines: " || chr(10) || ".join(lines).replace("' || chr(10) || '", "\n")
    head = joined(MODULE_HEAD).format(f="f")
    # A number is made a text once for its block, and a sentence cleaned only where its block holds it.
    clean = "regexp_replace(x.q, '[^A-Za-z0-9 ,]', '')"
    blocks = "CASE x.k "
    for kind, lines in enumerate(BLOCKS):
        body = joined(lines).replace("({n} % 7)", "(x.n % 7)").format(f="f", n="x.t", q=clean)
        blocks += f" WHEN {kind} THEN {body}"
    blocks += " END"
    kind = BLOCK_KIND.format(f="f", n="(i + 1)")
    numbered = f"transform(sentences, (q, i) -> struct(q, i + 1 AS n, CAST(i + 1 AS STRING) AS t, {kind} AS k))"
    if where != "true":
        numbered = f"filter({numbered}, x -> {where})"
    return F.expr(f"array_join(concat(array({head}), transform({numbered}, x -> {blocks})), chr(10))")


def python_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated Python module per document. Every ninth ends in a broken line; names follow ``FILENAME``, so
    some are not Python files at all."""
    pr = F.expr(PR_NUMBER.format(f="f"))
    broken = F.when(F.col("f") % 9 == 4, F.lit("\ndef broken(:")).otherwise("")
    return _sentences(spark, sf_dir).select(
        repo_of(pr).alias("repo"), pr.alias("pr_number"), F.col("f").alias("file_ord"),
        F.expr(FILENAME.format(f="f")).alias("filename"),
        F.concat(_module("true"), broken).alias("content"),
    )


# An added function with complexity 31.
HEAVY_FUNCTION = "def heavy(a):\n" + "\n".join("    if a: pass" for _ in range(30))


def code_pairs(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """Original and rewritten text of each module: blocks dropped, an import dropped, a heavy function added, words
    and logging removed, or the syntax broken, by document id. ``wanted``: only the modules of its ``file_ord``, which is a file's key here."""
    f = F.col("f")
    pr = F.expr(PR_NUMBER.format(f="f"))
    # Plain projections, so that texts nobody reads are not made.
    whole = _sentences(spark, sf_dir, wanted=wanted).select("f", "sentences", _module("true").alias("original"))
    p = whole.select("f", "original", F.when(f % 4 == 0, _module("x.n % 5 <> 0")).otherwise(F.col("original")).alias("kept"))
    rewritten = (
        F.when(f % 4 == 1, F.replace("kept", F.lit("import os\n"), F.lit("# no import\n")))
        .when(f % 4 == 2, F.concat("kept", F.lit("\n" + HEAVY_FUNCTION)))
        .when(
            f % 4 == 3,
            F.replace(
                F.replace("kept", F.lit("validate"), F.lit("check")), F.lit("logger.info("), F.lit("print(")
            ),
        )
        .otherwise(F.col("kept"))
    )
    return p.select(
        repo_of(pr).alias("repo"), pr.alias("pr_number"), f.alias("file_ord"),
        F.expr(FILENAME.format(f="f")).alias("filename"),
        F.col("original"),
        F.when(f % 8 == 6, F.concat(rewritten, F.lit("\ndef bad("))).otherwise(rewritten).alias("refactored"),
    )
