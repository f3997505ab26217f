import random

import pytest
from pyspark.sql import functions as F

from pullscan.functions import text as tx
from pullscan.operators import lines
from pullscan.operators.review import analyze, pr_decisions
from pullscan.rules.config import Delegation, RuleSet, RuleSpec, default_rules, load_rules, rules_from_dict


def found(files, rules):
    v = analyze(files, rules).orderBy("file_ord", "rule_ord", "line", "seq").collect()
    return [(r.rule_id, r.line, r.severity) for r in v]


def one(name, config, rule_id="S001", category="style", severity="warning"):
    return RuleSet((RuleSpec(rule_id, name, category, severity, config=config),))


def test_long_line(make_files):
    f = make_files(("t.py", "x = 1\n" + "a" * 100 + "\ny = 2"))
    assert found(f, one("line_length", {"max_length": 80})) == [("S001", 2, "warning")]


def test_url_and_import_lines_are_skipped(make_files):
    text = "# " + "http://e.org/" + "z" * 100 + "\n\timport " + "z" * 100 + "\nfrom x import " + "z" * 100
    f = make_files(("t.py", text))
    assert found(f, one("line_length", {"max_length": 80})) == []
    plain = one("line_length", {"max_length": 80, "ignore_urls": False, "ignore_imports": False})
    assert len(found(f, plain)) == 3


def test_secrets(make_files):
    rules = one("hardcoded_secrets", {"patterns": [r"password\s*=\s*['\"][^'\"]+['\"]"], "exclude_patterns": []},
                "SEC001", "security", "critical")
    f = make_files(("t.py", "  db_password='tulip-7'  # keep"))
    r = analyze(f, rules).first()
    assert (r.severity, r.code_snippet, r.confidence) == ("critical", "  db_password='[REDACTED]'  # keep", 0.85)


def test_excluded_secret(make_files):
    rules = one("hardcoded_secrets", {"patterns": [r"password\s*="], "exclude_patterns": [r"os\.environ", r"getenv"]},
                "SEC001", "security", "critical")
    assert found(make_files(("t.py", 'PassWord = os.Environ.get("PASSWORD")')), rules) == []


def test_defaults_load():
    ids = [r.rule_id for r in load_rules("/nonexistent/rules.yaml").rules]
    assert "S001" in ids and "SEC001" in ids
    assert [r.rule_id for r in load_rules().rules] == [r.rule_id for r in default_rules().rules]


def test_yaml_rules(tmp_path):
    p = tmp_path / "r.yaml"
    p.write_text("rules:\n  - id: S001\n    name: line_length\n    category: style\n    severity: info\n"
                 "    config: {max_length: 5}\n  - id: Z\n    name: nope\n    category: style\n    severity: info\n"
                 "  - id: Q\n    name: function_length\n    category: quality\n    severity: info\n    enabled: false\n"
                 "delegation:\n  criteria: {violations_per_file_threshold: 9}\n")
    rules = load_rules(str(p))
    assert [r.rule_id for r in rules.rules] == ["S001"]
    assert rules.delegation == Delegation(True, True, 9)
    assert rules.warnings == ("unknown rule nope",)


def test_bad_configuration():
    base = {"id": "A", "name": "sql_injection", "category": "security", "severity": "critical"}
    dropped = rules_from_dict({"rules": [{**base, "config": {"patterns": ["("]}}]})
    assert dropped.rules == () and "bad pattern" in dropped.warnings[0]
    with pytest.raises(ValueError):
        rules_from_dict({"rules": [{**base, "severity": "dire"}]})


def test_gate_scans_all_when_nothing_is_added(make_files):
    text = "try:\n    pass\nexcept:\n    pass\nexcept Exception:\n    pass"
    rules = default_rules().only("BP001")
    config = RuleSet((RuleSpec("BP001", "error_handling", "best_practices", "warning", config={}),))
    removed_only = "@@ -1,2 +1,1 @@\n try:\n-x"
    added = "@@ -1,2 +1,3 @@\n try:\n     pass\n+except:"
    outside = "@@ -1 +99 @@\n+x"
    assert found(make_files(("a.py", text, removed_only)), config) == [("BP001", 3, "warning"), ("BP001", 5, "warning")]
    assert found(make_files(("a.py", text, added)), config) == [("BP001", 3, "warning")]
    assert found(make_files(("a.py", text, outside)), config) == []
    # The line after the clause is taken from the whole file, added or not.
    only_broad = "@@ -1,2 +5,1 @@\n+except Exception:"
    assert found(make_files(("a.py", text, only_broad)), rules) == [("BP001", 5, "warning")]


def test_naming(make_files):
    text = "def GoodName(x):\nasync def _Hidden(x):\nclass bad_name(B):\nclass _X:\ndef ok_1():"
    v = analyze(make_files(("a.py", text)), default_rules().only("S002")).orderBy("line").collect()
    assert [(r.line, r.suggestion) for r in v] == [
        (1, "Rename to 'good_name'"), (3, "Rename to 'BadName'"), (4, "Rename to 'X'"),
    ]


def test_function_rules_ignore_the_diff(make_files):
    body = "\n".join("    if a and b or c: pass" for _ in range(4))
    f = make_files(("a.py", "def f(x):\n" + body, "@@ -1 +1 @@\n+zzz"))
    v = analyze(f, default_rules().only("Q001")).first()
    assert v.message == "Function 'f' has cyclomatic complexity of 13 (max: 10)" and v.confidence == 0.9


def test_unicode_words(make_files, spark):
    row = spark.createDataFrame([("éif if\u00a0or",)], "t string").select(
        tx.line_complexity(F.col("t")).alias("n"), tx.strip(F.lit("\u00a0 x\x1c")).alias("s")
    ).first()
    assert (row.n, row.s) == (2, "x")


def brute_spans(text):
    import re

    out, ls = [], text.split("\n")
    for i, line in enumerate(ls):
        m = re.match(r"^(\s*)(?:async\s+)?def\s+(\w+)\s*\(", line)
        if not m:
            continue
        rest = ls[i + 1:]
        stop = next((k for k, x in enumerate(rest) if x.strip() and len(x) - len(x.lstrip()) <= len(m[1])), len(rest))
        inside = rest[:stop]
        last = max([k + 1 for k, x in enumerate(inside) if x.strip()], default=0)
        whole = "\n".join(ls[i:i + 1 + last])
        hits = len(re.findall(r"\b(?:if|elif|for|while|and|or|except)\b", whole))
        out.append((m[2], i + 1, i + 1 + last, len(m[1]), 1 + hits, len(inside),
                    sum(not x.strip() for x in inside), sum(x.strip().startswith("#") for x in inside)))
    return out


def test_spans_against_brute_force(make_files):
    rng = random.Random(3)
    parts = ["", "  ", "x = 1", "    y or z", "        if a and b:", "\tq", "def a(x):", "    def b(x):", "\tasync def c(",
             "        def d():", "# c", "    # if", "):", "elif"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    got = {}
    for r in lines.function_spans(make_files(*[(f"f{i}", t) for i, t in enumerate(texts)]), ["filename"]).collect():
        got.setdefault(r.filename, []).append((r.name, r.start_line, r.end_line, r.indent, r.complexity, r.fn_lines, r.fn_blank, r.fn_comment))
    for i, t in enumerate(texts):
        assert got.get(f"f{i}", []) == brute_spans(t)


def decide(spark, violations, delegation):
    pr = spark.createDataFrame([("org/a", 1)], "repo string, pr_number bigint")
    files = spark.createDataFrame([("org/a", 1, "t.py")], "repo string, pr_number bigint, filename string")
    v = spark.createDataFrame([("org/a", 1, "t.py", *x) for x in violations],
                              "repo string, pr_number bigint, file string, rule_id string, severity string")
    return pr_decisions(pr, files, v, delegation).first()


def test_delegation(spark):
    d = Delegation(True, True, 5)
    assert decide(spark, [("SEC001", "critical")], d).should_delegate is True
    assert decide(spark, [("S001", "warning")], d).should_delegate is False
    assert decide(spark, [("Q001", "error")], d).should_delegate is True
    assert decide(spark, [("S001", "warning")] * 5, d).should_delegate is True
    assert decide(spark, [("SEC001", "critical")], Delegation(False, True, 1)).should_delegate is False
    none = decide(spark, [], d)
    assert (none.event, none.exit_status, none.total_files) == ("APPROVE", 0, 1)
    assert decide(spark, [("S001", "info")], d).event == "COMMENT"


def test_analysis_needs_no_shuffle(make_files):
    plan = analyze(make_files(("a.py", "x")), load_rules())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_partition_count_does_not_matter(make_files, spark):
    f = make_files(*[(f"f{i}.py", "def F(x):\n    except:\n" + "q" * 130) for i in range(30)])
    want = sorted(map(tuple, analyze(f, load_rules()).collect()))
    for n in (1, 16):
        assert sorted(map(tuple, analyze(f.repartition(n), load_rules()).collect())) == want
