"""Lookups of lines in spans, and sums over nested functions, against brute force."""

import random

from pyspark.sql import functions as F

from pullscan.operators import facts, lines

SPANS = "struct<functions:array<struct<name:string,start_line:int,end_line:int,docstring:string,calls:array<string>>>>"


def first_cover(spans, line):
    return next((n for n, a, b in spans if a <= line <= b), None)


def test_lines_in_spans(spark):
    rng = random.Random(9)
    rows = [("none", 7, []), ("null", 3, None)]
    for i in range(40):
        loc = rng.randint(1, 60)
        spans = []
        for j in range(rng.randint(0, 70 if i % 5 else 4)):
            a = rng.randint(1, loc)
            spans.append((f"s{j}", a, min(loc, a + rng.randint(0, 20))))
        rows.append((f"f{i}", loc, spans))
    df = spark.createDataFrame(
        [(k, loc, None if s is None else ([(n, a, b, "long text", ["x"]) for n, a, b in s],)) for k, loc, s in rows], f"file string, loc int, facts {SPANS}"
    )
    want = {(k, i): first_cover(s or [], i) for k, loc, s in rows for i in range(1, loc + 1)}
    own = facts.function_of_lines(df, ["file"])
    assert {(r.file, r.line): r.function_name for r in own.collect() if r.file != "null"} == {k: v for k, v in want.items() if k[0] != "null"}
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    asked = spark.createDataFrame([(k, i) for k, loc, _ in rows for i in (0, 1, loc, loc + 1, 10**6)] + [("unknown", 1)], "file string, line int")
    got = facts.function_at_line(asked, df, ["file"])
    for r in got.collect():
        s = next((s for k, _, s in rows if k == r.file), None)
        assert r.function_name == first_cover(s or [], r.line), r
    # Neither docstrings nor calls go to the lines.
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "docstring" not in text[: text.index("Join")] and "starts#" in text


def test_sums_of_deeply_nested_functions(make_files):
    depth = 300
    text = "\n".join(" " * i + f"def f{i}(a):" for i in range(depth)) + "\n" + " " * depth + "if a and b:\n\n# c\n" + " " * depth + "x = 1 or 2"
    got = {r.name: r for r in lines.function_spans(make_files(("deep.py", text)), ["filename"]).collect()}
    n = depth + 4
    for i in (0, 1, 63, 64, 65, 150, depth - 1):
        r = got[f"f{i}"]
        # The comment line stands at the margin and ends every function but none is left after it.
        assert (r.start_line, r.complexity, r.fn_lines, r.fn_blank, r.fn_comment) == (i + 1, 3, depth + 2 - (i + 1), 1, 0), (i, r)
    assert len(got) == depth and n == len(text.split("\n"))


def test_running_sums(spark):
    rng = random.Random(4)
    for n in (1, 63, 64, 65, 5000, 30_000):
        values = [rng.randint(0, 5) for _ in range(n)]
        pairs = [sorted((rng.randint(0, n), rng.randint(0, n))) for _ in range(30)] + [[0, n], [n, n], [0, 0]]
        df = spark.createDataFrame([(values, pairs)], "v array<int>, p array<array<int>>")
        sums = df.withColumn("r", lines._running(F.col("v"))).select(F.transform("p", lambda p: lines._sum_between(F.col("r"), p[0], p[1])).alias("s")).first().s
        assert list(sums) == [sum(values[a:b]) for a, b in pairs]


def test_outlines_against_a_plain_walk():
    """Names and scores from the quick walk are those of the facts, over this library's and Python's own sources."""
    import ast
    import glob
    import os
    import sysconfig

    from pullscan.operators import pyfacts

    std = sysconfig.get_paths()["stdlib"]
    files = sorted(glob.glob(os.path.join(std, "*.py")))[:120] + glob.glob(os.path.join(os.path.dirname(facts.__file__), "*.py"))
    for path in files:
        with open(path, encoding="utf-8", errors="replace") as f:
            code = f.read()
        tree = pyfacts.tree_or_none(code)
        if tree is None:
            continue
        want = pyfacts.facts_or_none(code)
        got = pyfacts.outline_of(tree)
        assert got["score"] == sum(x["complexity"] for x in want["functions"]), path
        assert got["functions"] == sorted({x["name"] for x in want["functions"] if x["class_name"] is None}), path
        assert got["classes"] == sorted({x["name"] for x in want["classes"]}) and got["imports"] == sorted({x["module"] for x in want["imports"]})
    assert all(f in {"arg", "args"} or not issubclass(t, ast.keyword) or f == "value" for t, fs in pyfacts._INSIDE.items() for f in fs)


def test_nested_functions_are_walked_once(monkeypatch):
    """The text of a call is cut out once, however many functions it is in; each of them has the call and its complexity."""
    from pullscan.operators import pyfacts

    depth, cut = 60, []
    code = "\n".join(" " * i + f"def f{i}(a=g{i}()):" for i in range(depth)) + "\n" + " " * depth + "return h() if x else 1\n"
    plain = pyfacts._Source.text
    monkeypatch.setattr(pyfacts._Source, "text", lambda self, node: cut.append(node) or plain(self, node))
    got = pyfacts.facts_or_none(code)["functions"]
    assert len(cut) == depth + 1
    assert [f["name"] for f in got] == [f"f{i}" for i in range(depth)] and {f["complexity"] for f in got} == {2}
    assert [f["calls"] for f in got] == [sorted([f"g{k}" for k in range(i + 1, depth)] + ["h"]) for i in range(depth)]


def test_few_files_of_a_batch_are_objects_at_one_time(monkeypatch):
    import pyarrow as pa

    from pullscan.operators import pyfacts

    sizes, plain = [], pa.array
    texts = plain([f"def f{i}(): return g{i}()\n" if i % 9 else None for i in range(300)])
    monkeypatch.setattr(pyfacts.pa, "array", lambda x, **k: sizes.append(len(x := list(x))) or plain(x, **k))
    got = pyfacts.facts_batch(texts)
    assert max(sizes) <= pyfacts._AT_ONCE and [x and x["functions"][0]["calls"][0] for x in got.to_pylist()] == [f"g{i}" if i % 9 else None for i in range(300)]
    yes = plain([True] * 300)
    pair, lean = pyfacts.pair_batch(texts, texts, yes).to_pylist(), pyfacts.outlines_batch(texts, texts, yes).to_pylist()
    assert max(sizes) <= pyfacts._AT_ONCE and [(p["before"], p["after"]) for p in pair] == [(p["before"], p["after"]) for p in lean]
    assert len(pyfacts.facts_batch(plain([], type=pa.string()))) == 0


def test_tasks_of_a_spread_table_grow_with_it(spark):
    from pullscan.sources import derived as d

    n = lambda rows: d.spread(spark.range(rows)).rdd.getNumPartitions()
    assert n(10) == spark.sparkContext.defaultParallelism and n(100_000) == 100_000 // d.ROWS_OF_A_TASK


def test_names_are_compared_without_compiling(spark):
    from pullscan.operators import verify

    shape = "repo string, pr_number bigint, file_ord bigint, filename string, original string, refactored string"
    pairs = spark.createDataFrame([("r", 1, 0, "a.py", "def a(): pass\nimport x", "import y\nreturn 1"), ("r", 1, 1, "b.md", "def q(x):", "z")], shape)
    gone = verify.changed_names(pairs, True)
    assert sorted((r.file_ord, r.kind, r.name) for r in gone.collect()) == [(0, "functions", "a"), (0, "imports", "x"), (1, "functions", "q")]
    plan = gone._jdf.queryExecution().executedPlan().toString()
    assert "outlines_batch" in plan and "pair_batch" not in plan


def test_security_words_in_any_letters(spark):
    """Words are found in either case, also in letters that a pattern without case takes for an ASCII one."""
    from pullscan.operators import verify

    texts = ["HASH(x)", "ha\u017fh", "VER\u0130FY", "val\u0131date", "rehash", "try:", "logger.info(x)", "mylogger.x(", "x", None]
    df = spark.createDataFrame([(t, "x") for t in texts], "a string, b string")
    got = [r.i for r in df.select(verify.critical_issues(F.col("a"), F.col("b")).alias("i")).collect()]
    word = lambda w: [f"All {w} code was removed"]
    assert got[:6] == [word("hashing"), word("hashing"), word("verification"), word("validation"), [], ["All try/except blocks were removed"]]
    assert got[6:] == [["All logging statements were removed"], [], [], []]


def test_syntax_of_a_tree_is_that_of_its_text():
    from pullscan.operators import pyfacts

    for code in ("x = 1", "return 1", "def f(:", "def f():\n  yield\nawait x", "x = 1\n  y", "nonlocal a", "a\x00b", "from __future__ import nothing", "def f(a, a): pass", "(" * 300 + ")" * 300, "f'{x!z}'", ""):
        assert pyfacts.syntax_of_tree(pyfacts.tree_or_none(code), code) == pyfacts.syntax_of(code), code


def test_json_texts_are_those_python_reads(spark):
    import json

    from pullscan.operators.answers import _valid

    texts = [
        '{"a":1}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1,"a":2}', "[1,2]", '"s"', "5", "nul", "null", '{"a":NaN}', "{'a':1}", '{"a":1,}', "", '  {"a": {"b":[1,"x"]}}  ', '{"a":01}',
        '{"a":"\\x"}', '{"a":"\n"}', '[{"a":1}] y', '{"a":{"b":1,"b":2}}', "true", "-", "[1,2", '{"a":1/*c*/}', "1],[2", '{"a":1}}', "1,2", '1,"y":2', '{"a":1}]', "[1]]", "1}", " ", '{"a":1}\n\n',
        '"x" "y"', "[]", "{}", "tru", '{"a":Infinity}', '{"a":"é\\u00e9\U0001F600"}', "{a:1}", '{"a":.5}', "+1", '{"a":[1,2,]}', '{"a" 1}', '{"x":1,"x":[}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", _valid(F.col("t")).isNotNull().alias("ok")).collect():
        try:
            json.loads(r.t)
            want = True
        except ValueError:
            want = False
        assert r.ok == want, r.t


def test_segments_of_spans_against_all_spans():
    """The first span of the list that covers a line, whatever order spans are in, found without looking at each for each line."""
    from pullscan.operators import pyfacts

    rng = random.Random(5)
    for n in (0, 1, 5, 40):
        first = [rng.randint(1, 60) for _ in range(n)]
        last = [a + rng.randint(-1, 30) for a in first]
        names = [f"f{i}" for i in range(n)]
        got = pyfacts._segments(names, first, last)
        assert got["starts"] == sorted({*first, *(b + 1 for b in last)})
        assert got["names"] == [next((names[i] for i in range(n) if first[i] <= x <= last[i]), None) for x in got["starts"]]
    assert pyfacts._segments(None, None, None) is None
    # A file of 100,000 functions in one another's way: every span against every line would be 10 ** 10 steps.
    many = pyfacts._segments(["f"] * 100_000, list(range(1, 100_001)), [200_000] * 100_000)
    assert len(many["starts"]) == 100_001 and many["names"][-2:] == ["f", None]


def test_a_version_of_a_file_is_parsed_where_it_differs(monkeypatch):
    """The outline of a rewritten text comes from the parts it shares with the original; only the others are parsed."""
    import ast

    from pullscan.operators import pyfacts

    parts = [f"@cached\ndef f{i}(a):\n    return a if a else {i}\n\n\n" for i in range(50)]
    a, b = "import os\n" + "".join(parts), "import re\n" + "".join(parts[:20] + ["def new(): pass\n"] + parts[21:])
    want, seen, plain = (pyfacts.outline_or_none(a), pyfacts.outline_or_none(b)), [], ast.parse
    monkeypatch.setattr(pyfacts.ast, "parse", lambda code: seen.append(code) or plain(code))
    assert pyfacts.pair_outlines(a, b)[:2] == want
    assert seen == [a, "import re\n", "def new(): pass\n"]


def test_outlines_of_pairs_are_those_of_the_whole_texts():
    """Parts that only look like statements of the module: in strings, behind others, cut off, in another grammar."""
    import pyarrow as pa

    from pullscan.operators import pyfacts

    f, g, c = "def f(a):\n    return a and 1\n", "def g():\n    x = [1 for i in y]\n", "class C:\n    def m(self): pass\n    import z\n"
    rest = "import a, b\nfrom .x import y\n" + g + c
    texts = [
        f + rest, rest + f, 'x = """\n' + f + '"""\n' + rest, 'x = """\ny"""; z = 1\n' + f + rest, "(\n" + f + ")\n" + rest, rest + "@d\n" + f, rest + "@d(\n  1)\n# c\n@e\n" + f, f + rest + "x = 1 \\\n",
        "if x:\n  pass\n" + f + "else:\n  pass\n" + rest, "try:\n  pass\nexcept A:\n  pass\n" + f + rest, "try:\n  pass\n" + f + rest, f + rest + "return 5\n", rest + f + "def bad(", "from __future__ import barry_as_FLUFL\n" + f + rest + "x != 1\n",
        f.replace("\n", "\r\n") + rest, f + "\x0c" + rest, "\ufeff" + f + rest, f + "match x:\n  case 1: pass\n" + rest, f + f + f + rest, "", "# c\n", "x\x00", None, f, rest, f + rest + "x = " + "-" * 3000 + "1\n", '"""doc"""\n' + rest + f,
        rest + "async " + f, 'x = f"""\n{' + "f(1)}\n" + '"""\n' + f + rest, rest + "type X = int\n" + f,
    ]
    pairs = [(a, b) for a in texts for b in texts]
    columns = [pa.array(x, pa.string()) for x in zip(*pairs, strict=True)]
    one = {t: (pyfacts.syntax_of(t), pyfacts.outline_or_none(t)) for t in texts}
    want = [{"syntax": one[b][0], "before": one[a][1], "after": one[b][1]} for a, b in pairs]
    assert pyfacts.pair_batch(*columns, pa.array([True] * len(pairs))).to_pylist() == want
    assert sum(pyfacts.pair_outlines(a, b)[2] is None for a, b in pairs if one[b][1]) > 50


def test_methods_come_with_their_class(spark, make_files):
    """A class holds the names of its methods: no search of all methods of the file for each class."""
    code = "\n".join(f"class A:\n  def m{i}(self): pass\n  if x:\n    def no(self): pass\n  class B:\n    async def n{i}(self): pass" for i in range(30))
    found = facts.facts_classes(facts.code_facts(make_files(("a.py", code), ("b.ts", "class Q:\n")), ["filename"]), ["filename"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "methods_" not in plan
    assert sorted((r.name, r.start_line, *r.methods) for r in found.collect()) == sorted(
        [("A", 6 * i + 1, f"m{i}") for i in range(30)] + [("B", 6 * i + 5, f"n{i}") for i in range(30)] + [("Q", 1)]
    )


def test_answers_meet_checks_and_no_texts(spark):
    """The answers are joined to finished checks; below the join no text is dealt out or sorted by file."""
    from pullscan.operators import verify

    shape = "repo string, pr_number bigint, file_ord bigint, filename string, original string, refactored string"
    rows = [("r", 1, 0, "a.py", "x = 1", "x = 2"), ("r", 1, 1, "b.py", "x = 1", "def f("), ("r", 1, 2, "c.py", "x", "x"), (None, 1, 3, "d.py", "x", "x")]
    told = "repo string, pr_number bigint, file_ord bigint, filename string, other string, parsed struct<equivalent:boolean,confidence:double,differences:array<string>,assessment:string>"
    yes, no = (True, 0.9, [], "same"), (False, 0.9, ["d"], None)
    answers = [("r", 1, 0, "a.py", "o", yes), ("r", 1, 0, "a.py", "o", no), ("r", 1, 1, "b.py", "o", yes), (None, 1, 3, "d.py", "o", yes)]
    got = verify.verify(spark.createDataFrame(rows, shape), spark.createDataFrame(answers, told))
    last = sorted((r.file_ord, len(r.checks), r.checks[-1].name, r.checks[-1].status) for r in got.collect())
    same = "semantic_equivalence"
    assert last == [(0, 5, same, "failed"), (0, 5, same, "passed"), (1, 1, "syntax_validation", "failed"), (2, 5, same, "warning"), (3, 5, same, "warning")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Join") < plan.index("pair_batch")


def test_a_rewritten_text_is_parsed_once(monkeypatch):
    """A text put together of known parts is compiled from their trees; one that the parser refuses is not given to it again."""
    import builtins

    import pyarrow as pa

    from pullscan.operators import pyfacts

    texts = []

    def counted(code, *args, **kwargs):
        texts.extend([code] if isinstance(code, str) else [])
        return builtins.compile(code, *args, **kwargs)

    parts = [f"@cached\ndef f{i}(a):\n    return a if a else {i}\n\n\n" for i in range(20)]
    a = "import os\n" + "".join(parts)
    future = "from __future__ import annotations\n"
    pairs = [
        (a, a.replace("import os", "# gone")), (a, a + "def bad("), (a, "x = (1,\n"), ("def f(:", "def f(:"), (a, a + "return 5\n"),
        (a, a + future), (future + a, a + future), (future + a, future + "".join(parts[5:])), ("x = 1\n" + a, a + "global x\n"),
    ]
    want = [pyfacts.syntax_of(b) for _, b in pairs]
    columns = [pa.array(x, pa.string()) for x in zip(*pairs, strict=True)]
    monkeypatch.setattr(pyfacts, "compile", counted, raising=False)
    got = pyfacts.pair_batch(*columns, pa.array([True] * len(pairs))).to_pylist()
    assert [g["syntax"] for g in got] == want and [w["ok"] for w in want] == [True, *[False] * 6, True, True]
    # From the text only where compiling fails behind the parser, or the place of a statement counts.
    assert texts == [b for _, b in pairs[4:8]]


def test_bare_words_as_statements_of_a_module():
    """``pass``, ``global``: statements that hold nothing stand at the top of a text as well."""
    from pullscan.operators import pyfacts

    for a in ("pass\n", "import os\nglobal x\npass\n", "break\n"):
        for b in ("pass\nimport a\n", a, a + "import b\n"):
            assert pyfacts.pair_outlines(a, b)[:2] == (pyfacts.outline_or_none(a), pyfacts.outline_or_none(b))


def test_only_texts_with_other_letters_are_replaced_in(spark):
    """Letters are looked at one by one only in texts that hold some outside ASCII."""
    from pullscan.operators import verify

    df = spark.createDataFrame([("HASH(x)", "x"), ("ha\u017fh", "x"), ("\u00e4 auth", None), (None, "x")], "a string, b string")
    out = df.select(verify.critical_issues(F.col("a"), F.col("b")).alias("i"))
    assert [r.i for r in out.collect()] == [["All hashing code was removed"], ["All hashing code was removed"], [], []]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan.lower() or "bytelength" in plan.lower()
