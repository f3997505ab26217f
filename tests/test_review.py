import json

from pyspark.sql import functions as F

from pullscan.operators import answers as ans
from pullscan.operators import facts, review as rv, rewrite, testlogs, verify
from pullscan.plans import review as plan
from pullscan.rules.config import default_rules, load_rules
from pullscan.sources import derived, reviewlog, tables

PR = "repo string, pr_number bigint, title string, body string, base_branch string, head_branch string, author string, commits_count int"


def test_markdown(spark):
    dec = spark.createDataFrame([("r", 1, 5, 3, 1, 1, 1, 0, 2)], "repo string, pr_number bigint, total_files bigint, total_violations bigint, "
                                "critical_count bigint, error_count bigint, warning_count bigint, info_count bigint, files_with_issues bigint")
    files = spark.createDataFrame([("r", 1, "test.py"), ("r", 1, "main.py")], "repo string, pr_number bigint, file string")
    rows = rv.summary_markdown(dec, files, files).orderBy("section", F.col("file").asc_nulls_first()).collect()
    md = "\n".join(r.markdown for r in rows)
    assert "AI Code Review Summary" in md and "| Files Reviewed | 5 |" in md and "| Total Issues | 3 |" in md
    assert "\n### Files with Issues\n\n- `main.py`\n- `test.py`\n\n### 🔧 Automatic Refactoring Applied\n\n- `main.py`" in md
    assert [(r.section, r.file) for r in rows][:3] == [(0, None), (1, None), (1, "main.py")]


def test_payload_splits_a_hot_pull_request(spark):
    """Comments never stand on the side of an outer join that cannot be split."""
    dec = spark.createDataFrame([("r", 1, "COMMENT", 2), ("r", 2, "APPROVE", 0)], "repo string, pr_number bigint, event string, total_violations bigint")
    c = spark.createDataFrame([("r", 1, 0, 1, 0, "a.py", 3, "x", "error", "Q1", None), ("r", 1, 1, 1, 0, "b.py", 4, "y", "info", "Q1", None)],
                              "repo string, pr_number bigint, file_ord bigint, rule_ord int, seq int, file string, line int, body string, severity string, rule_id string, suggestion_code string")
    out = rv.review_payload(c, dec)
    assert "Outer" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.pr_number, r.event, r.file_ord, len(r.comments)) for r in out.collect()}
    assert got == {(1, "COMMENT", 0, 1), (1, "COMMENT", 1, 1), (2, "APPROVE", None, 0)}


def test_two_findings_on_one_line_get_their_own_texts(spark):
    cols = "repo string, pr_number bigint, file_ord bigint, rule_ord int, seq int, file string, line int, message string, suggestion string, severity string, rule_id string"
    v = spark.createDataFrame([("r", 1, 0, 8, i, "a.py", 3, f"m{i}", "", "error", "AI") for i in (0, 1)], cols)
    g = spark.createDataFrame([("r", 1, "a.py", 3, "AI", 8, i, f"g{i}") for i in (0, 1)], "repo string, pr_number bigint, file string, line int, rule_id string, rule_ord int, seq int, generated_body string")
    assert sorted(r.body for r in rv.review_comments(v, g).collect()) == ["g0", "g1"]


def test_prompts_are_whole(spark):
    prompt = lambda *a: spark.range(1).select(ans.equivalence_prompt(F.lit("a" * 5000), F.lit("b" * 5000), F.array(*[F.lit(f"m{i}") for i in range(9)]), *a)).first()[0]
    assert "a" * 5000 in prompt() and "b" * 5000 in prompt() and "m8" in prompt()
    assert "a" * 2001 not in prompt(2000, 5) and "m5" not in prompt(2000, 5)


def test_classes_of_one_name(make_files):
    code = "class A:\n    class Meta:\n        def one(self): pass\n\nclass B:\n    class Meta:\n        def two(self): pass\n"
    f = facts.code_facts(make_files(("a.py", code)), ["filename"])
    got = {(r.name, r.start_line): r.methods for r in facts.facts_classes(f, ["filename"]).collect()}
    assert got["Meta", 2] == ["one"] and got["Meta", 6] == ["two"]


def test_form_feed_is_no_line_end():
    from pullscan.operators.pyfacts import facts_or_none

    f = facts_or_none("x = 1\n\x0c\nLIMIT = 2\r\ndef f(a) -> int:\n    return g(a)\n")
    assert [g["name"] for g in f["globals"]] == ["x", "LIMIT"]
    assert f["functions"][0]["return_type"] == "int" and f["functions"][0]["calls"] == ["g"]


def test_timed_out_runs_have_no_counts(spark):
    logs = spark.createDataFrame([(1, "pytest", 1, "3 passed in 1.0s\ntests/a.py::t PASSED", "", True)], "id int, tool string, returncode int, stdout string, stderr string, timed_out boolean")
    r = testlogs.pytest_suites(logs, ["id"]).first()
    assert (r.status, r.passed, r.total_tests) == ("error", 0, 0)
    assert testlogs.pytest_results(logs, ["id"]).count() == 0


def test_a_pattern_the_engine_refuses_drops_one_rule(spark):
    from pullscan.rules.config import rules_from_dict

    rule = lambda i, p: {"id": i, "name": "hardcoded_secrets", "category": "security", "severity": "critical", "config": {"patterns": [p]}}
    # A brace that is no repetition is a plain character in Python; the translated pattern has it so too.
    rs = rules_from_dict({"rules": [rule("A0", 'f"{x}"'), rule("A", "\ud800"), rule("B", "secret"), {**rule("C", "x"), "enabled": False}, {**rule("D", "x"), "name": "nobody"}]})
    assert [r.rule_id for r in rs.rules] == ["A0", "B"] and len(rs.warnings) == 2


def test_log_times_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        t = F.timestamp_micros(F.lit(0))
        assert spark.range(1).select(reviewlog.iso_utc(t)).first()[0] == "1970-01-01T00:00:00.000000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_cluster_needs_a_shared_folder():
    from pullscan.session import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,1024]"

            @staticmethod
            def getConf():
                return Conf()

    try:
        shared_dir(Session)
    except ValueError:
        return
    raise AssertionError("a folder of one machine was taken for a shared one")


def body(spark, **kw):
    c = {"body": "b", "severity": "error", "rule_id": None, "suggestion_code": None, **kw}
    col = lambda k: F.lit(c[k]).cast("string")
    return spark.range(1).select(rv.comment_body(col("body"), col("severity"), col("rule_id"), col("suggestion_code"))).first()[0]


def test_comment_body(spark):
    assert body(spark, body="This is a test issue", rule_id="Q001") == "❌ **ERROR** [Q001]\n\nThis is a test issue"
    text = body(spark, severity="warning", suggestion_code="def my_function():")
    assert text.endswith("**Suggested fix:**\n```suggestion\ndef my_function():\n```")


def test_file_gate(spark):
    rows = [("a.py", "modified", "x", True), ("a.PY", "modified", "x", False), ("Makefile", "added", "x", True),
            ("v1.2/Makefile", "added", "x", False), ("a.min.js", "modified", "x", False), ("a.py", "removed", "x", False),
            ("a.py", "modified", "", False), ("a.py", "modified", None, False), ("x.map.py", "modified", "x", False)]
    df = spark.createDataFrame(rows, "filename string, status string, patch string, want boolean")
    got = df.select("want", rv.should_analyze(F.col("filename"), F.col("status"), F.col("patch")).alias("g")).collect()
    assert all(r.want == r.g for r in got)


def fixed(make_files, text, rules=None):
    f = make_files(("a.py", text))
    v = rv.analyze(f, rules or default_rules())
    return rewrite.apply_fixes(f, v).first()


def test_fixes_in_order(make_files):
    text = "#!/x\nimport re\n\ndef GetIt(a):\n    GetIt(1)\n\tpassword = 'x'\n    except:\n"
    r = fixed(make_files, text)
    assert r.refactored_code == (
        "#!/x\nimport re\nimport os\n\ndef get_it(a):\n    get_it(1)\n password = os.environ.get('PASSWORD')\n"
        "    except Exception as e:\n"
    )
    assert list(r.violations_fixed) == ["BP001", "SEC001", "S002"] and r.success
    assert r.changes_description.split("\n")[-1] == "Added: import os"


def test_one_rename_feeds_the_next(make_files):
    # Line 2 renames fooBar to foo_bar everywhere; line 1 then defines foo_bar and is renamed to its own suggestion.
    r = fixed(make_files, "class foo_bar:\ndef fooBar():\n    x")
    assert r.refactored_code == "class FooBar:\ndef FooBar():\n    x"
    assert r.changes_description == "Renamed 'fooBar' to 'foo_bar'\nRenamed 'foo_bar' to 'FooBar'"


def one_after_another(content, fixes):
    """The fixes by their definition: each on the whole text the one before left."""
    import re

    lines, done = content.split("\n"), []
    for line, rule, suggestion in fixes:
        text = lines[line - 1]
        if rule == "S002":
            m = re.match(r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", text) or re.match(r"^\s*class\s+(\w+)\s*[:\(]", text)
            new = re.search(r"Rename to '(\w+)'", suggestion)
            if m and new:
                lines = re.sub(rf"\b{m[1]}\b", new[1], "\n".join(lines)).split("\n")
                done.append(rule)
        elif rule == "BP001":
            if re.match(r"^\s*except\s*:", text):
                lines[line - 1] = " " * (len(text) - len(text.lstrip())) + "except Exception as e:"
                done.append(rule)
        else:
            for word in ("password", "api_key", "secret", "token"):
                m = re.search(rf"(\w*{word}\w*)\s*=\s*['\"][^'\"]+['\"]", text, re.I)
                if m:
                    name = m[1].upper() if m[1].upper().endswith(word.upper()) else f"{m[1].upper()}_{word.upper()}"
                    lines[line - 1] = " " * (len(text) - len(text.lstrip())) + f"{m[1]} = os.environ.get('{name}')"
                    done.append(rule)
                    break
    return "\n".join(lines), done


def test_folded_fixes_against_one_after_another(spark):
    import random

    rng = random.Random(6)
    rows = []
    for i in range(120):
        names = [f"{a}{b}" for a in "Ab" for b in ("x", "y", "Exception", "os")] + ["e", "environ", "PASSWORD", "password", "é1"]
        kinds = ["def {n}({m}):", "class {n}({m}):", "    {n} = {m}({n})", "  except:", "\tpassword = '{n}'", "{n}_token = \"{m}\"", "", "x.{n}.{m} # {n}", "except: {n}"]
        text = [rng.choice(kinds).format(n=rng.choice(names), m=rng.choice(names)) for _ in range(rng.randint(1, 25))]
        fixes = []
        for line in range(len(text), 0, -1):
            for rule in ("S002", "SEC001", "BP001"):
                for _ in range(rng.choice([0, 1, 1, 2])):
                    fixes.append((line, rule, f"Rename to '{rng.choice(names)}'" if rng.random() < 0.9 else "none"))
        rows.append((i, "\n".join(text), fixes))
    df = spark.createDataFrame(rows, "i int, content string, fixes array<struct<line:int,rule_id:string,suggestion:string>>")
    for r in df.select("i", rewrite.fold_fixes(F.col("content"), F.col("fixes")).alias("f")).collect():
        code, done = one_after_another(rows[r.i][1], rows[r.i][2])
        assert (r.f.code, list(r.f.fixed)) == (code, done), rows[r.i]


def test_a_thousand_renames(make_files):
    text = "\n".join(f"def getIt{i}(a):\n    return getIt{(i + 1) % 1000}(a) or getIt{i}" for i in range(1000))
    r = fixed(make_files, text)
    want = "\n".join(f"def get_it{i}(a):\n    return get_it{(i + 1) % 1000}(a) or get_it{i}" for i in range(1000))
    assert r.refactored_code == want and len(r.violations_fixed) == 1000


def test_nothing_to_fix(make_files, spark):
    r = fixed(make_files, "x" * 200 + "\n" + "y" * 200)
    assert (r.success, r.changes_description, r.refactored_code == r.original_code) == (False, "No automatic fixes available", True)
    f = make_files(("a.py", "except:\nexcept:"))
    v = rv.analyze(f, default_rules())
    r = rewrite.apply_fixes(f.withColumn("content", F.lit(None).cast("string")), v).first()
    assert (r.success, r.error_message, r.original_code) == (False, "Could not fetch file contents", "")


def test_plans_for_commits_and_rollback(spark):
    prs = spark.createDataFrame([("r", 1, "t", None, "main", "head", "me", 1)], PR)
    contents = spark.createDataFrame([("r", "a.py", "head", "s1", "new"), ("r", "a.py", "c0", "s0", "old")],
                                     "repo string, path string, ref string, sha string, content string")
    res = spark.createDataFrame([("r", 1, "a.py", "z", ["S002", "BP001", "BP001", "SEC001"], True), ("r", 1, "b.py", "z", ["S002"], True)],
                                "repo string, pr_number bigint, filename string, refactored_code string, violations_fixed array<string>, success boolean")
    plans = {r.filename: r for r in tables.commit_plan(res, prs, contents).collect()}
    assert plans["a.py"].action == "update" and plans["a.py"].message == "Auto-fix: S002, BP001, BP001"
    assert plans["b.py"].action == "create"
    refs = spark.createDataFrame([("r", 1, "0123456789", "c0")], "repo string, pr_number bigint, sha string, ref string")
    back = tables.rollback_plan(res, refs, prs, contents).collect()
    assert [(r.filename, r.content, r.message) for r in back] == [("a.py", "old", "Rollback: Revert a.py to 0123456")]
    assert spark.range(1).select(tables.last_rollback_point(F.array().cast("array<string>"))).first()[0] is None


def pairs(spark, original, refactored, filename="a.py"):
    return spark.createDataFrame([("r", 1, 0, filename, original, refactored)],
                                 "repo string, pr_number bigint, file_ord bigint, filename string, original string, refactored string")


def result(spark, *args, parsed=None):
    answers = None
    if parsed is not None:
        answers = spark.createDataFrame([("r", 1, 0, "a.py", parsed)], "repo string, pr_number bigint, file_ord bigint, filename string, response string").select(
            "repo", "pr_number", "file_ord", "filename", ans.parse_equivalence(F.col("response")).alias("parsed"))
    return verify.verification_results(verify.verify(pairs(spark, *args), answers)).first()


def test_verification(spark):
    same = "import os\ndef f():\n    return 1\n"
    assert result(spark, same, same).overall_message == "All verification checks passed"
    bad = result(spark, same, "def f(:\n")
    assert (bad.passed, bad.safe_to_commit, bad.requires_human_review) == (False, False, False)
    warn = result(spark, same, "def g():\n    return 1\n")
    assert warn.overall_message == "Verification passed with 2 warnings" and warn.requires_human_review
    lost = result(spark, "authorize()\nlogger.info(1)\n", "x\n")
    assert lost.overall_message == "Verification failed: 1 checks failed"
    assert result(spark, "return 1", "return 1").overall_message == "Refactored code has syntax errors"
    yes = '{"equivalent": true, "confidence": 0.6}'
    assert result(spark, same, same, parsed=yes).requires_human_review
    assert not result(spark, same, same, parsed="no json").passed
    assert result(spark, same, same, parsed="[1]").requires_human_review


def test_outlines_agree_with_facts():
    from pullscan.operators import pyfacts

    texts = [
        "import os, a.b\nfrom .. import q\nfrom m import x\n@d(i for i in y)\nclass A(B):\n  @p\n  def m(self, k=[z for z in w]):\n    if a and b or c: return [i for i in a]\n"
        "  if x:\n    def hidden(self):\n      while a: pass\n  class N:\n    async def n(self):\n      async with a: pass\n",
        "def f(a, b=1 if x else 2) -> (y and z):\n  try: pass\n  except* E: pass\n  try: pass\n  except E: pass\n  def g():\n    for i in a: assert i\n    class L:\n      def lm(self):\n        with q: pass\n"
        "  match a:\n    case 1: pass\n    case _: g()\nif u:\n  def f(): return {k: v for k, v in w}\n",
        "return 1", "x = 1\n", "", "def f(:",
    ]
    for t in texts:
        facts_, lean = pyfacts.facts_or_none(t), pyfacts.outline_or_none(t)
        assert (facts_ is None) == (lean is None)
        if lean:
            assert lean == {
                "functions": sorted({x["name"] for x in facts_["functions"] if x["class_name"] is None}),
                "classes": sorted({x["name"] for x in facts_["classes"]}),
                "imports": sorted({x["module"] for x in facts_["imports"]}),
                "score": sum(x["complexity"] for x in facts_["functions"]),
            }


def test_model_rewrites(spark):
    from pullscan.operators.rewrite import with_model_rewrites

    shape = "repo string, pr_number bigint, file_ord bigint, filename string, original_code string, refactored_code string, changes_description string, violations_fixed array<string>, success boolean, error_message string"
    none = "No automatic fixes available"
    done = spark.createDataFrame([
        ("r", 1, 0, "a", "x", "x", none, [], False, None), ("r", 1, 1, "b", "x", "y", "z", ["S002"], True, None),
        ("r", 1, 2, "c", "", "", "Failed to fetch file", [], False, "e"), ("r", 1, 3, "d", "x", "x", none, [], False, None)], shape)
    v = spark.createDataFrame([("r", 1, f, o, 1, 0, i) for f in "abcd" for o, i in ((0, "S001"), (1, "SEC002"))], "repo string, pr_number bigint, file string, rule_ord int, line int, seq int, rule_id string")
    told = spark.createDataFrame([("r", 1, f, '{"refactored_code": "os.environ", "explanation": "why"}') for f in "abc"] + [("r", 1, "d", "{}")], "repo string, pr_number bigint, filename string, response string")
    got = {r.filename: r for r in with_model_rewrites(done, v, told).collect()}
    assert (got["a"].refactored_code, got["a"].changes_description) == ("import os\nos.environ", "why\nAdded: import os")
    assert (got["a"].violations_fixed, got["a"].success) == (["S001", "SEC002"], True)
    assert [got[k].success for k in "bcd"] == [True, False, False] and got["b"].refactored_code == "y"


def test_facts(spark):
    code = (
        "import os, sys as s\nfrom . import q\nfrom m import *\nX = 1\n_y = 2\n@dec(1)\nclass A(B, c.D):\n    '''doc'''\n"
        "    z = 1\n    @property\n    async def m(self, *a: int, k, **kw) -> 'é':\n        return [i for i in a if i and k and self.x.y()]\n"
        "    class N: pass\ndef f(a, /, b=1):\n    import re\n    def g(): pass\n    v = g()\n    try: pass\n    except E: pass\n"
    )
    row = facts.code_facts(spark.createDataFrame([("a.py", code)], "filename string, content string"), ["filename"]).first()
    fn = {f.name: f for f in row.facts.functions}
    assert list(fn) == ["f", "g", "m"]
    assert fn["m"].parameters == ["self", "*a", "k", "**kw"] and fn["m"].return_type == "'é'" and fn["m"].is_async
    assert fn["m"].complexity == 4 and fn["m"].calls == ["self.x.y"] and fn["m"].decorators == ["@property"]
    assert (fn["f"].complexity, fn["f"].calls, fn["f"].start_line, fn["f"].end_line) == (2, ["g"], 14, 19)
    assert [(c.name, c.bases, c.docstring, c.decorators) for c in row.facts.classes] == [("A", ["B"], "'''doc'''", ["@dec(1)"]), ("N", [], None, [])]
    assert [(i.module, i.names, i.alias) for i in row.facts.imports] == [
        ("os", [], None), ("sys", [], "s"), (".", ["q"], None), ("m", ["*"], None), ("re", [], None)]
    assert [(g.name, g.line) for g in row.facts.globals] == [("X", 4)]
    assert row.complexity_score == 2 + 1 + 4 and row.source == "ast"
    broken = facts.code_facts(spark.createDataFrame([("a.py", "import os, sys\ndef f(:")], "filename string, content string"), ["filename"]).first()
    assert (broken.source, broken.facts.imports[0].module, broken.facts.functions[0].name) == ("regex", "os,", "f")


def test_model_json(spark):
    cases = [('{"issues": [], "summary": "a"}', True, "a"), ('x ```json\n{"summary": "b"}\n``` y', True, "b"),
             ('so {"summary": "c"} end', True, "c"), ('{"summary": "first", "issues": [], "summary": "d"}', True, "d"), ("z" * 600, False, "z" * 500), ("} {", False, "} {"), ("", False, "")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "k int, response string")
    got = ans.parse_model_json(df, ["k"]).orderBy("k").collect()
    assert [(r.is_json, r.summary) for r in got] == [(c[1], c[2]) for c in cases]


def test_logs(spark):
    logs = [
        (1, "pytest", 1, False, "1 failed, 2 passed in 0.5s\na/b.py::T::t PASSED\nTOTAL  10  2  80%", ""),
        (2, "pytest", 1, False, "3 passed, 1 failed, 2 errors in 1s", ""),
        (3, "pytest", 1, True, "", ""),
        (4, "unittest", 1, False, "", "FAILED (errors=1, failures=2)"),
    ]
    df = spark.createDataFrame(logs, "run_id int, tool string, returncode int, timed_out boolean, stdout string, stderr string")
    s = {r.run_id: r for r in testlogs.suites(df, ["run_id"]).collect()}
    assert (s[1].passed, s[1].failed, s[1].errors, s[1].duration_ms, s[1].coverage_percent) == (2, 1, 0, 500.0, 80.0)
    assert (s[2].passed, s[2].failed, s[2].errors, s[2].total_tests) == (3, 1, 2, 6)
    assert (s[3].status, s[3].success_rate) == ("error", 1.0) and s[4].failed == 2
    assert [(r.name, r.status) for r in testlogs.pytest_results(df, ["run_id"]).collect()] == [("T::t", "passed")]


def review_inputs(spark, code, tests=None):
    patch = "@@ -1 +1,9 @@\n" + "\n".join("+" + x for x in code.split("\n"))
    return plan.ReviewInputs(
        spark.createDataFrame([("r", 1, "t", None, "main", "head", "me", 1), ("r", 2, "t", "b", "main", "h2", "me", 1)], PR),
        spark.createDataFrame([("r", 1, 0, "a.py", "modified", 9, 0, patch)],
                              "repo string, pr_number bigint, file_ord bigint, filename string, status string, additions int, deletions int, patch string"),
        spark.createDataFrame([("r", "a.py", "head", "s", code)], "repo string, path string, ref string, sha string, content string"),
        spark.createDataFrame([("r", 1, 0, "aaaaaaaaaa"), ("r", 1, 1, "bbbbbbbbbb")], "repo string, pr_number bigint, commit_ord bigint, sha string"),
        tests=tests,
    )


CODE = "def GetIt():\n    try:\n        pass\n    except:\n        pass\npassword = 'x'"


def test_whole_review(spark):
    i = review_inputs(spark, CODE)
    r = plan.review(spark, i, plan.ReviewOptions(rules=load_rules(), materialize=True))
    route = {x.pr_number: x for x in r.route.collect()}
    assert route[1].refactor and route[1].verification_passed and not route[1].rollback and route[1].refactoring_performed
    assert not route[2].refactor and route[2].n_rewritten == 0
    assert [(x.file) for x in plan.mark_refactored(r.route, r.results).collect()] == ["a.py"]
    ev = plan.review_events(r, i, F.lit("2026-01-01").cast("timestamp")).filter("pr_number = 1").orderBy("step", "rule_ord", "line").collect()
    assert [e.event for e in ev][:3] == ["review_started", "pr_fetched", "rollback_point_created"]
    assert json.loads(ev[2].value)["sha"] == "bbbbbbb"
    assert [e.event for e in ev][-1] == "review_completed" and json.loads(ev[-1].value)["total_violations"] == 3
    typed = reviewlog.parse_review_log(spark.createDataFrame([(e.value,) for e in ev], "value string"))
    assert typed.filter("event = 'verification'").first().passed == "true"


def test_failed_tests_roll_back(spark):
    tests = spark.createDataFrame([("r", 1, 3, 4)], "repo string, pr_number bigint, passed int, total_tests int")
    r = plan.review(spark, review_inputs(spark, CODE, tests), plan.ReviewOptions(rules=load_rules()))
    x = r.route.filter("pr_number = 1").first()
    assert (x.test, x.tests_passed, x.rollback, x.rollback_performed, x.refactoring_performed) == (True, False, True, True, False)


def test_log_round_trip(spark, tmp_path):
    src = spark.createDataFrame([("r", 1)], "repo string, pr_number bigint")
    e = reviewlog.event_rows(src, 1, "review_started", F.lit("2026-02-13 10:30:00").cast("timestamp"), {"pr": F.col("pr_number")})
    for _ in range(2):
        reviewlog.write_review_log(e, str(tmp_path / "log"))
    rows = reviewlog.read_review_log(spark, str(tmp_path / "log")).collect()
    assert [(x.event, x.pr, str(x.timestamp)) for x in rows] == [("review_started", 1, "2026-02-13 10:30:00")] * 2
    sample = '{"timestamp": "2026-02-13T10:30:03.500Z", "event": "refactor_applied", "file": "src/config.py", "violations_fixed": 1}'
    got = reviewlog.parse_review_log(spark.createDataFrame([(sample,)], "value string")).first()
    assert (got.file, got.violations_fixed, got.timestamp.microsecond) == ("src/config.py", 1, 500000)


def test_the_route_is_made_once(spark):
    """Its pull requests' tests and commits are sought once, not for each event that reads it."""
    i = review_inputs(spark, CODE)
    r = plan.review(spark, i, plan.ReviewOptions(rules=load_rules(), materialize=True))
    assert any("route" in f for f in r.route.inputFiles())
    assert "Join" not in r.route._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_some_files(spark, tmp_path):
    """Texts meet the wanted files before anything is made of them, and are dealt to tasks behind that."""
    docs = spark.range(60).selectExpr("CASE WHEN id % 20 < 19 THEN id % 50 END AS doc_id", "concat('One. Two. Three ', id) AS text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    wanted = spark.createDataFrame([(n,) for n in (*range(0, 60, 3), 3, None)], "file_ord bigint")
    pairs = derived.code_pairs(spark, str(tmp_path), wanted)
    plain = derived.code_pairs(spark, str(tmp_path)).join(wanted, "file_ord", "left_semi").select(pairs.columns)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, plain.collect())) and pairs.count() == plain.count() > 15
    steps = pairs._jdf.queryExecution().executedPlan().toString()
    assert steps.index("RoundRobin") < steps.index("Join")
