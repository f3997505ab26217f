from pullscan.operators import diff

SIMPLE = "@@ -1,3 +1,4 @@\n import os\n+import sys\n \n def main():"
TWO_ADDED = "@@ -1,2 +1,4 @@\n line1\n+added1\n+added2\n line2"
K = ["filename"]


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_simple_patch(make_files):
    h = diff.diff_hunks(make_files(("t.py", "", SIMPLE)), K).collect()
    assert [(r.new_start, r.new_count) for r in h] == [(1, 4)]


def test_added_lines_and_numbers(make_files):
    f = make_files(("t.py", "", TWO_ADDED))
    assert rows(diff.added_lines(f, K), "content") == [("added1",), ("added2",)]
    assert rows(diff.changed_line_numbers(f, K), "line_number") == [(2,), (3,)]


def test_patch_rules(make_files):
    """Text before the first header, missing and zero counts, removed lines, the no-newline row, a trailing newline."""
    patch = "junk\n@@ -5 +7,0 @@ def f(): \n a\n-b\n-c\n+d\n\\ No newline at end of file\n e\n"
    f = make_files(("t.py", "", patch))
    h = diff.diff_hunks(f, K).first()
    assert (h.old_start, h.old_count, h.new_start, h.new_count, h.header) == (5, 1, 7, 0, "def f():")
    assert rows(diff.diff_lines(f, K), "line_number", "content", "change_type") == [
        (7, "a", "context"), (8, "b", "removed"), (8, "c", "removed"), (8, "d", "added"), (9, "e", "context"),
        (10, "", "context"),
    ]


def test_no_diff(make_files):
    f = make_files(("a.py", "", None), ("b.py", "", ""))
    assert diff.diff_present(f).count() == 0
    assert diff.diff_lines(f, K).count() == 0


def test_chunks_cross_hunks_but_not_context(make_files):
    patch = "@@ -1,1 +1,2 @@\n x\n+a\n@@ -10,0 +20,3 @@\n+b\n\\ No newline at end of file\n+c\n-z\n+d"
    f = make_files(("t.py", "", patch))
    assert rows(diff.added_chunks(f, K), "start_line", "end_line", "code") == [(2, 21, "a\nb\nc"), (22, 22, "d")]
    assert rows(diff.added_chunks(f, K, 3), "chunk_no", "n_lines") == [(0, 3)]


def brute(patch):
    """Line-by-line counter."""
    import re

    out, hunk, n = [], -1, 0
    for line in patch.split("\n"):
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)
        if m:
            hunk, n = hunk + 1, int(m.group(3))
        elif hunk < 0 or line[:1] == "\\":
            pass
        elif line[:1] == "-":
            out.append((hunk, n, line[1:], "removed"))
        else:
            out.append((hunk, n, line[1:] if line[:1] in ("+", " ") else line, "added" if line[:1] == "+" else "context"))
            n += 1
    return out


def test_against_brute_force(make_files):
    import random

    rng = random.Random(7)
    patches = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(0, 30)):
            lines.append(rng.choice(["+a", "-b", " c", "", "\\ No newline", f"@@ -1 +{rng.randint(0, 9)},2 @@ x", "d", "+", "-"]))
        patches.append("\n".join(lines))
    f = make_files(*[(f"f{i}", "", p) for i, p in enumerate(patches)])
    got = {}
    for r in diff.diff_lines(f, K).collect():
        got.setdefault(r.filename, []).append((r.hunk_no, r.line_number, r.content, r.change_type))
    nested = {r.filename: r.hunks for r in diff.diff_nested(f, K).collect()}
    for i, p in enumerate(patches):
        expected = brute(p)
        assert got.get(f"f{i}", []) == expected
        if p:
            flat = [(n, x.line_number, x.content, x.change_type) for n, h in enumerate(nested[f"f{i}"]) for x in h.lines]
            assert flat == expected
