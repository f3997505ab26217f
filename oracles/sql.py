"""DuckDB SQL for each query, written from the recipe of the derived tables and the rule texts.

Diffs, spans and facts are derived here from how the texts were built (windows, self-joins, block numbers), not by
parsing them again, so both sides reach their results on different ways.
"""

from __future__ import annotations

from pullscan.sources import derived as d

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def oracle(name: str, sql: str, *needs: str) -> None:
    done: list[str] = []

    def add(n):
        for m in CTES[n][0]:
            add(m)
        if n not in done:
            done.append(n)

    for n in needs:
        add(n)
    with_ = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in done)
    ORACLES[name] = (f"WITH {with_}\n" if done else "") + sql


NL = "chr(10)"
ASCII = r"regexp_replace({t}, '[^\x00-\x7F]', 'w', 'g')"
REPO = "'org/r' || ({pr} % 5)"

# ------------------------------------------------------------------------------------------ derived tables

cte("raw", """SELECT doc_id AS f, unnest(l) AS q, CAST(generate_subscripts(l, 1) AS INT) AS n
 FROM (SELECT doc_id, string_split_regex(text, '[.\\n]') AS l FROM documents)""")
cte("src", "SELECT f, n, " + d.LINE_RECIPE.format(q="q", n="n", s="s").replace("floor", "floor")
    + " AS t FROM (SELECT *, " + d.RESIDUE.format(f="f", n="n", q="q") + " AS s FROM raw)", "raw")
PR = d.PR_NUMBER.format(f="f")
cte("files", f"""SELECT f, {PR} AS pr_number, {REPO.format(pr='(' + PR + ')')} AS repo, {d.FILENAME.format(f='f')} AS filename,
 {d.STATUS.format(f='f')} AS status FROM (SELECT doc_id AS f FROM documents)""")
cte("nl", "SELECT f, CAST(count(*) AS INT) AS n_lines FROM src GROUP BY f", "src")
cte("marks", f"SELECT f, n, t, (n - 1) // 42 AS h, {d.PATCH_MARK.format(f='f', n='n')} AS p FROM src", "src")
cte("content", f"SELECT f, string_agg(t, {NL} ORDER BY n) AS content FROM src GROUP BY f", "src")
cte("hunks", f"""SELECT f, h, min(n) AS first, count(*) FILTER (p <> '+') AS oc, count(*) FILTER (p <> '-') AS nc,
 string_agg(p || t, {NL} ORDER BY n) AS body FROM marks GROUP BY f, h""", "marks")
cte("patches", f"""SELECT f, string_agg('@@ -' || first || ',' || oc || ' +' || first || ',' || nc || ' @@ ctx ' || h
 || {NL} || body, {NL} ORDER BY h) || {NL} || '\\ No newline at end of file' AS patch
 FROM hunks WHERE f % 23 <> 0 GROUP BY f""", "hunks")
cte("changes", """SELECT fl.*, coalesce(a.additions, 0) AS additions, coalesce(a.deletions, 0) AS deletions, p.patch FROM files fl
 LEFT JOIN (SELECT f, CAST(count(*) FILTER (p = '+') AS INT) AS additions, CAST(count(*) FILTER (p = '-') AS INT) AS deletions
  FROM marks GROUP BY f) a USING (f) LEFT JOIN patches p USING (f)""", "files", "marks", "patches")
cte("dl", """SELECT f, CAST(h AS INT) AS hunk_no, n, p, t,
 CAST(h * 42 + 1 + coalesce(sum(CASE WHEN p <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY f, h ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS line_number,
 CASE p WHEN '+' THEN 'added' WHEN '-' THEN 'removed' ELSE 'context' END AS change_type
 FROM marks WHERE f % 23 <> 0""", "marks")
cte("runs", """SELECT *, sum(CASE WHEN p <> '+' THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY n) AS island FROM dl""", "dl")
cte("chunks", f"""SELECT f, min(n) AS first_n, min_by(line_number, n) AS start_line, max_by(line_number, n) AS end_line,
 CAST(count(*) AS INT) AS n_lines, string_agg(t, {NL} ORDER BY n) AS code FROM runs WHERE p = '+' GROUP BY f, island""", "runs")
cte("chunks3", "SELECT *, CAST(row_number() OVER (PARTITION BY f ORDER BY first_n) - 1 AS INT) AS chunk_no FROM chunks WHERE n_lines >= 3", "chunks")

cte("prs", f"""SELECT {REPO.format(pr='c_custkey')} AS repo, c_custkey AS pr_number, 'Change ' || c_name AS title,
 CASE WHEN c_custkey % 2 <> 0 THEN c_mktsegment ELSE '' END AS body, 'main' AS base_branch,
 'feature/' || c_custkey AS head_branch, c_name AS author, c_nationkey AS commits_count FROM customer""")
cte("contents", """SELECT f, repo, filename AS path, 'feature/' || pr_number AS ref, md5('h' || f) AS sha, content
  FROM files JOIN content USING (f) WHERE f % 31 <> 0
 UNION ALL SELECT f, repo, filename, 'base/' || pr_number, md5('b' || f),
  CASE WHEN strpos(content, chr(10)) > 0 THEN substr(content, strpos(content, chr(10)) + 1) ELSE '' END
  FROM files JOIN content USING (f) WHERE f % 37 <> 0""", "files", "content")
cte("commits", f"SELECT {REPO.format(pr='o_custkey')} AS repo, o_custkey AS pr_number, o_orderkey AS commit_ord, md5(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders")
cte("last_commit", "SELECT repo, pr_number, arg_max(sha, commit_ord) AS sha FROM commits GROUP BY 1, 2", "commits")

# --------------------------------------------------------------------------------------------------- spans

DEF_RE = r"^\s*(?:async\s+)?def\s+(\w+)\s*\("
CLASS_RE = r"^\s*class\s+(\w+)\s*[:\(]"
cte("nb", "SELECT f, n, t, length(t) - length(ltrim(t)) AS ind FROM src WHERE trim(t) <> ''", "src")
cte("defs", f"SELECT f, n, ind, regexp_extract(t, '{DEF_RE}', 1) AS name FROM nb WHERE regexp_matches(t, '{DEF_RE}')", "nb")
cte("stops", """SELECT d.f, d.n, d.ind, d.name, coalesce(min(b.n), any_value(nl.n_lines) + 1) AS stop FROM defs d JOIN nl USING (f)
 LEFT JOIN nb b ON b.f = d.f AND b.n > d.n AND b.ind <= d.ind GROUP BY d.f, d.n, d.ind, d.name""", "defs", "nl", "nb")
cte("spans", """SELECT s.f, s.n, s.ind, s.name, s.stop, max(b.n) AS end_line FROM stops s JOIN nb b
 ON b.f = s.f AND b.n >= s.n AND b.n < s.stop GROUP BY ALL""", "stops", "nb")
KEYWORDS = f"len(regexp_extract_all({ASCII.format(t='x.t')}, '\\b(?:if|elif|for|while|and|or|except)\\b'))"
cte("fns", f"""SELECT s.*, CAST(1 + sum(CASE WHEN x.n <= s.end_line THEN {KEYWORDS} ELSE 0 END) AS INT) AS complexity,
 CAST(s.stop - s.n - 1 AS INT) AS fn_lines,
 CAST(count(*) FILTER (x.n > s.n AND trim(x.t) = '') AS INT) AS fn_blank,
 CAST(count(*) FILTER (x.n > s.n AND ltrim(x.t) LIKE '#%') AS INT) AS fn_comment
 FROM spans s JOIN src x ON x.f = s.f AND x.n >= s.n AND x.n < s.stop GROUP BY ALL""", "spans", "src")

# --------------------------------------------------------------------------------------------------- rules

# Patterns of the shipped rules.
SEC_RE = ["password\\s*=\\s*[''\"][^''\"]+[''\"]", "api_key\\s*=\\s*[''\"][^''\"]+[''\"]", "secret\\s*=\\s*[''\"][^''\"]+[''\"]",
          "token\\s*=\\s*[''\"][^''\"]+[''\"]", "AWS_SECRET", "PRIVATE_KEY"]
SEC_EX = ["password\\s*=\\s*[''\"][''\"]", "os\\.environ", "getenv"]
SQL_RE = [f"f[''\"]{w}.*\\{{.*\\}}" for w in ("SELECT", "INSERT", "UPDATE", "DELETE")] + ["\\.format\\(.*\\).*SELECT", "\\+.*SELECT"]


def any_of(patterns, t="t"):
    return "(" + " OR ".join(f"regexp_matches({t}, '{p}', 'i')" for p in patterns) + ")"


REDACT = "regexp_replace({t}, '(\")[^''\"]+\"|('')[^''\"]+''', '\\1\\2[REDACTED]\\1\\2', 'g')"
WORDS = "string_split(regexp_replace(regexp_replace({n}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[_\\s]+', '_', 'g'), '_')"
SNAKE = "array_to_string([lower(w) for w in " + WORDS + " if w <> ''], '_')"
UPPER = "array_to_string([upper(w) for w in " + WORDS + " if w <> ''], '_')"
PASCAL = "array_to_string([upper(w[1]) || lower(w[2:]) for w in " + WORDS + " if w <> ''], '')"

# Rule order, id, name, category, severity, confidence.
RULES = {
    "S001": (0, "line_length", "style", "warning", 1.0),
    "S002": (1, "naming_conventions", "style", "warning", 1.0),
    "Q001": (2, "function_complexity", "quality", "error", 0.9),
    "Q002": (3, "function_length", "quality", "warning", 1.0),
    "SEC001": (4, "hardcoded_secrets", "security", "critical", 0.85),
    "SEC002": (5, "sql_injection", "security", "critical", 1.0),
    "BP001": (6, "error_handling", "best_practices", "warning", 1.0),
}


def rule_selects(ln: str, fn: str) -> dict[str, list[str]]:
    """SELECTs over ``ln(f, n, t, nxt)`` and ``fn`` (function rows)."""

    def one(rid, seq, source, where, message, suggestion, snippet):
        o, name, cat, sev, conf = RULES[rid]
        return (f"SELECT f, {o} AS rule_ord, {seq} AS seq, '{rid}' AS rule_id, '{name}' AS rule_name, '{cat}' AS category, "
                f"'{sev}' AS severity, CAST(n AS INT) AS line, {message} AS message, {suggestion} AS suggestion, {snippet} AS code_snippet, "
                f"CAST({conf} AS DOUBLE) AS confidence FROM {source} WHERE {where}")

    fname = f"regexp_extract(t, '{DEF_RE}', 1)"
    cname = f"regexp_extract(t, '{CLASS_RE}', 1)"
    counted = "(fn_lines - fn_blank - fn_comment)"
    return {
        "S001": [one("S001", 0, ln, "length(t) > 120 AND NOT contains(t, 'http://') AND NOT contains(t, 'https://') AND NOT (trim(t) LIKE 'import %' OR trim(t) LIKE 'from %')",
                     "'Line exceeds 120 characters (length: ' || length(t) || ')'",
                     "'Break this line into multiple lines or refactor for readability'",
                     "CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END")],
        "S002": [one("S002", 0, ln, f"regexp_matches(t, '{DEF_RE}') AND {fname} NOT LIKE '\\_%' ESCAPE '\\' AND NOT regexp_matches({fname}, '^[a-z][a-z0-9_]*$')",
                     f"'Function ''' || {fname} || ''' should use snake_case'", f"'Rename to ''' || {SNAKE.format(n=fname)} || ''''", "trim(t)"),
                 one("S002", 1, ln, f"regexp_matches(t, '{CLASS_RE}') AND NOT regexp_matches({cname}, '^[A-Z][a-zA-Z0-9]*$')",
                     f"'Class ''' || {cname} || ''' should use PascalCase'", f"'Rename to ''' || {PASCAL.format(n=cname)} || ''''", "trim(t)")],
        "Q001": [one("Q001", 0, fn, "complexity > 10", "'Function ''' || name || ''' has cyclomatic complexity of ' || complexity || ' (max: 10)'",
                     "'Consider breaking this function into smaller, focused functions'", "''")],
        "Q002": [one("Q002", 0, fn, f"{counted} > 50", f"'Function ''' || name || ''' is ' || {counted} || ' lines long (max: 50)'",
                     "'Consider extracting parts into smaller helper functions'", "''")],
        "SEC001": [one("SEC001", 0, ln, f"{any_of(SEC_RE)} AND NOT {any_of(SEC_EX)}", "'Potential hardcoded secret or credential detected'",
                       "'Use environment variables or a secrets manager instead'", REDACT.format(t="t"))],
        "SEC002": [one("SEC002", 0, ln, any_of(SQL_RE), "'Potential SQL injection vulnerability - using string formatting in SQL query'",
                       "'Use parameterized queries: cursor.execute(''SELECT * FROM users WHERE id = ?'', (user_id,))'", "trim(t)")],
        "BP001": [one("BP001", 0, ln, "regexp_matches(t, '^\\s*except\\s*:')", "'Bare ''except:'' clause catches all exceptions including SystemExit and KeyboardInterrupt'",
                      "'Catch specific exceptions: ''except (ValueError, TypeError) as e:'''", "trim(t)"),
                  one("BP001", 1, ln, "regexp_matches(t, '^\\s*except\\s+Exception\\s*:') AND coalesce(trim(nxt) = 'pass', false)",
                      "'Empty exception handler - exceptions are silently ignored'", "'Log the exception or handle it appropriately'", "trim(t)")],
    }


cte("wl", "SELECT f, n, t, lead(t) OVER (PARTITION BY f ORDER BY n) AS nxt FROM src", "src")
cte("gate", "SELECT DISTINCT f, line_number FROM dl WHERE p = '+'", "dl")
cte("gated", """SELECT wl.* FROM wl WHERE f NOT IN (SELECT f FROM gate)
 UNION ALL SELECT wl.* FROM wl JOIN gate g ON g.f = wl.f AND g.line_number = wl.n""", "wl", "gate")
cte("analyzable", """SELECT * FROM changes WHERE status <> 'removed' AND patch IS NOT NULL AND patch <> ''
 AND filename NOT LIKE '%.min.js%' AND (filename NOT LIKE '%.%' OR regexp_extract(filename, '\\.([^.]*)$', 1) IN
 ('py','js','ts','jsx','tsx','java','go','rb','rs','c','cpp','h','hpp','cs'))""", "changes")
cte("reviewed", "SELECT a.* FROM analyzable a JOIN prs USING (repo, pr_number)", "analyzable", "prs")
cte("rl", "SELECT g.* FROM gated g JOIN reviewed r USING (f) WHERE f % 31 <> 0", "gated", "reviewed")
cte("rf", "SELECT g.* FROM fns g JOIN reviewed r USING (f) WHERE f % 31 <> 0", "fns", "reviewed")
_reviewed = " UNION ALL ".join(s for v in rule_selects("rl", "rf").values() for s in v)
cte("v", f"SELECT fl.repo, fl.pr_number, f AS file_ord, x.* EXCLUDE (f), fl.filename AS file, 0 AS \"column\" FROM ({_reviewed}) x JOIN files fl USING (f)", "rl", "rf", "files")
V_COLS = "file_ord, rule_id, line, message, suggestion, code_snippet, confidence"
for _rid, _key in [("S001", "rule_line_length"), ("S002", "rule_naming"), ("Q001", "rule_complexity"), ("Q002", "rule_function_length"),
                   ("SEC001", "rule_secrets"), ("SEC002", "rule_sql_injection"), ("BP001", "rule_error_handling")]:
    _u = " UNION ALL ".join(rule_selects("wl", "fns")[_rid])
    _whole = ", (SELECT any_value(s.t) FROM wl s WHERE s.f = u.f AND s.n = u.line) AS line_text" if _rid == "S001" else ""
    oracle(_key, f"SELECT f AS file_ord, rule_id, line, message, suggestion, code_snippet, confidence{_whole} FROM ({_u}) u", *(("fns",) if _rid[0] == "Q" else ("wl",)))
oracle("analyze", "SELECT repo, pr_number, file_ord, rule_ord, seq, rule_id, rule_name, category, severity, file, line, \"column\", message, suggestion, code_snippet, confidence FROM v", "v")
_few = " UNION ALL ".join(s for r in ("S002", "SEC001", "BP001") for s in rule_selects("wl", "fns")[r])
oracle("rules_enabled", f"SELECT rule_id, count(*) AS n FROM ({_few}) GROUP BY 1", "wl")
_table = " UNION ALL ".join(f"SELECT {o} AS rule_ord, '{r}' AS rule_id, '{n}' AS rule_name, '{c}' AS category, '{s}' AS severity" for r, (o, n, c, s, _) in RULES.items())
oracle("load_rules", f"SELECT t.*, count(v.rule_id) AS n FROM ({_table}) t LEFT JOIN v USING (rule_id) GROUP BY ALL", "v")
cte("docl", """SELECT *, lead(t) OVER (PARTITION BY f ORDER BY n) AS nxt FROM (SELECT doc_id AS f, unnest(l) AS t, CAST(generate_subscripts(l, 1) AS INT) AS n
 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''))""")
# No line of the documents defines a function, so the two rules about functions find nothing there.
_docs = " UNION ALL ".join(s for r in ("S001", "S002", "SEC001", "SEC002", "BP001") for s in rule_selects("docl", "fns")[r])
for _k in ("analyze_documents", "stream_review"):
    oracle(_k, f"SELECT f AS file_ord, rule_id, line, message, suggestion, code_snippet, confidence FROM ({_docs})", "docl")
cte("docv", f"""SELECT 'doc' || f AS file, *, CASE WHEN suggestion <> '' THEN message || {NL} || {NL} || '**Suggestion:** ' || suggestion ELSE message END AS body FROM ({_docs})""", "docl")
oracle("stream_events", """SELECT 'review_started' AS event, CAST(0 AS BIGINT) AS pr, CAST(NULL AS INT) AS files_count, CAST(NULL AS VARCHAR) AS rule_id, CAST(NULL AS VARCHAR) AS file,
  CAST(NULL AS INT) AS line, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS body, CAST(NULL AS BIGINT) AS total_violations, CAST(NULL AS BIGINT) AS comments_posted
 UNION ALL SELECT 'pr_fetched', NULL, CAST(count(*) AS INT), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM documents
 UNION ALL SELECT 'rule_triggered', NULL, NULL, rule_id, file, line, severity, NULL, NULL, NULL FROM docv
 UNION ALL SELECT 'comment_generated', NULL, NULL, rule_id, file, line, severity, body, NULL, NULL FROM docv
 UNION ALL SELECT 'review_completed', NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), count(*) FROM docv""", "docv")
oracle("custom_rule", """SELECT f AS file_ord, 'X001' AS rule_id, n AS line, 'Comment contains ''note''' AS message, '' AS suggestion,
 trim(t) AS code_snippet, CAST(0.5 AS DOUBLE) AS confidence FROM src WHERE ltrim(t) LIKE '#%' AND contains(t, 'note')""", "src")

# ------------------------------------------------------------------------------------------------- sources

oracle("scan_pull_requests", "SELECT * FROM prs", "prs")
oracle("scan_file_changes", "SELECT repo, pr_number, f AS file_ord, filename, status, additions, deletions, patch, status = 'removed' AS is_deleted FROM changes", "changes")
cte("at_head", """SELECT fl.*, p.head_branch AS ref, c.content FROM files fl JOIN prs p USING (repo, pr_number)
 LEFT JOIN contents c ON c.repo = fl.repo AND c.path = fl.filename AND c.ref = p.head_branch""", "files", "prs", "contents")
for _k in ("file_at_ref", "file_at_ref_bucketed"):
    oracle(_k, "SELECT repo, pr_number, f AS file_ord, filename, ref, content FROM at_head", "at_head")
oracle("checked_out_files", "SELECT 'org/docs' AS repo, 'd' || doc_id AS path, 'main' AS ref, sha1(text || chr(10)) AS sha, text || chr(10) AS content FROM documents")
oracle("handoff_maps", "SELECT repo, pr_number, filename AS path, content FROM at_head WHERE status <> 'removed' AND length(content) > 0", "at_head")
oracle("latest_commit", "SELECT * FROM last_commit", "last_commit")
oracle("rollback_point_rows", "SELECT repo, pr_number, commit_ord AS saved_ord, sha, commit_ord = max(commit_ord) OVER (PARTITION BY repo, pr_number) AS is_last FROM commits", "commits")
oracle("rollback_points", "SELECT repo, pr_number, count(*) AS n_points, max(commit_ord) AS last_ord, arg_max(sha, commit_ord) AS last_sha FROM commits GROUP BY 1, 2", "commits")
oracle("source_lines", "SELECT f AS file_ord, filename, n AS line, t AS text, CAST(length(t) - length(ltrim(t)) AS INT) AS indent, trim(t) = '' AS is_blank FROM src JOIN files USING (f)", "src", "files")
oracle("source_lines_documents", """SELECT doc_id, n AS line, t AS text, CAST(length(t) - length(ltrim(t)) AS INT) AS indent, trim(t) = '' AS is_blank FROM
 (SELECT doc_id, unnest(l) AS t, CAST(generate_subscripts(l, 1) AS INT) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
oracle("analyzable_files", "SELECT repo, pr_number, f AS file_ord, filename, status FROM analyzable", "analyzable")
oracle("file_extension", "SELECT f AS file_ord, filename, CASE WHEN filename LIKE '%.%' THEN regexp_extract(filename, '(\\.[^.]*)$', 1) ELSE '' END AS extension FROM files", "files")
oracle("is_deleted", "SELECT f AS file_ord, status = 'removed' AS is_deleted FROM files", "files")
oracle("is_added", "SELECT f AS file_ord, filename, hunk_no, line_number, p = '+' AS is_added FROM dl JOIN files USING (f)", "dl", "files")
oracle("changed_line_gate", "SELECT f AS file_ord, filename, n AS line, t AS text, nxt AS next_text FROM gated JOIN files USING (f) JOIN content USING (f) WHERE content <> ''", "gated", "files", "content")

# ---------------------------------------------------------------------------------------------------- diff

oracle("diff_present", "SELECT repo, pr_number, f AS file_ord, filename, CAST(length(patch) AS INT) AS n_chars FROM changes WHERE patch <> ''", "changes")
oracle("diff_hunks", """SELECT f AS file_ord, filename, CAST(h AS INT) AS hunk_no, first AS old_start, CAST(oc AS INT) AS old_count, first AS new_start,
 CAST(nc AS INT) AS new_count, 'ctx ' || h AS header FROM hunks JOIN files USING (f) WHERE f % 23 <> 0""", "hunks", "files")
oracle("diff_lines", "SELECT f AS file_ord, filename, hunk_no, line_number, t AS content, change_type FROM dl JOIN files USING (f)", "dl", "files")
oracle("added_lines", "SELECT f AS file_ord, filename, hunk_no, line_number, t AS content FROM dl JOIN files USING (f) WHERE p = '+'", "dl", "files")
oracle("changed_line_numbers", "SELECT f AS file_ord, filename, line_number FROM dl JOIN files USING (f) WHERE p = '+'", "dl", "files")
oracle("diff_nested", """SELECT f AS file_ord, filename, CAST(to_json(list({'old_start': first, 'old_count': oc, 'new_start': first, 'new_count': nc, 'lines': ls} ORDER BY h)) AS VARCHAR) AS hunks
 FROM (SELECT f, hunk_no AS h, list({'line_number': line_number, 'content': t, 'change_type': change_type} ORDER BY n) AS ls FROM dl GROUP BY f, hunk_no) JOIN hunks USING (f, h) JOIN files USING (f) GROUP BY 1, 2""", "dl", "hunks", "files")
oracle("added_chunks", "SELECT f AS file_ord, filename, CAST(row_number() OVER (PARTITION BY f ORDER BY first_n) - 1 AS INT) AS chunk_no, start_line, end_line, n_lines, code FROM chunks JOIN files USING (f)", "chunks", "files")
oracle("added_chunks_min3", "SELECT f AS file_ord, filename, chunk_no, start_line, end_line, n_lines, code FROM chunks3 JOIN files USING (f)", "chunks3", "files")

# ------------------------------------------------------------------------------------------ names and lines

_names = "(SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS name FROM part)"
oracle("name_matches", f"""SELECT p_partkey, name, regexp_matches(name, '^[a-z][a-z0-9_]*$') AS snake_case, regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') AS "PascalCase",
 regexp_matches(name, '^[A-Z][A-Z0-9_]*$') AS "UPPER_SNAKE_CASE", regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') AS "camelCase" FROM {_names}""")
oracle("name_convert", f"""SELECT p_partkey, name, {SNAKE.format(n='name')} AS snake_case, {PASCAL.format(n='name')} AS "PascalCase", {UPPER.format(n='name')} AS "UPPER_SNAKE_CASE", name AS "camelCase" FROM {_names}""")
oracle("function_spans", "SELECT f AS file_ord, filename, name, n AS start_line, end_line, CAST(ind AS INT) AS indent, complexity, fn_lines, fn_blank, fn_comment FROM fns JOIN files USING (f)", "fns", "files")
oracle("line_complexity", f"SELECT f AS file_ord, filename, n AS line, CAST({KEYWORDS} AS INT) AS hits FROM src x JOIN files USING (f)", "src", "files")
oracle("redact_quotes", f"SELECT f AS file_ord, filename, n AS line, {REDACT.format(t='t')} AS redacted FROM src JOIN files USING (f)", "src", "files")
oracle("facts_regex", f"""SELECT f AS file_ord, filename, kind, name, n AS line, flag FROM (
 SELECT f, n, 'function' AS kind, regexp_extract(t, '{DEF_RE}', 1) AS name, regexp_matches(t, '^\\s*async\\s+def') AS flag FROM src WHERE regexp_matches(t, '{DEF_RE}')
 UNION ALL SELECT f, n, 'class', regexp_extract(t, '{CLASS_RE}', 1), false FROM src WHERE regexp_matches(t, '{CLASS_RE}')
 UNION ALL SELECT f, n, 'import', CASE WHEN trim(t) LIKE 'from %' THEN regexp_extract(trim(t), '^from\\s+(\\S+)', 1) ELSE regexp_extract(trim(t), '^import\\s+(\\S+)', 1) END,
  trim(t) LIKE 'from %' FROM src WHERE regexp_matches(trim(t), '^(from\\s+(\\S+)\\s+)?import\\s+(.+)')) JOIN files USING (f)""", "src", "files")
oracle("loc_sloc", "SELECT f AS file_ord, filename, CAST(count(*) AS INT) AS loc, CAST(count(*) FILTER (trim(t) <> '' AND ltrim(t) NOT LIKE '#%') AS INT) AS sloc FROM src JOIN files USING (f) GROUP BY 1, 2", "src", "files")

# ------------------------------------------------------------------------------------------------ roll-ups

cte("vf", """SELECT repo, pr_number, file, count(*) AS n_violations, count(*) FILTER (severity = 'critical') AS critical_count,
 count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count, count(*) FILTER (severity = 'info') AS info_count,
 count(*) FILTER (rule_id = 'Q001') AS complexity_count, count(*) FILTER (rule_id <> 'LLM001') AS static_count FROM v GROUP BY 1, 2, 3""", "v")
oracle("violations_per_file", "SELECT * FROM vf", "vf")
oracle("fixable_files", "SELECT repo, pr_number, file, n_violations FROM vf WHERE n_violations >= 2", "vf")
for _k in ("distinct_files", "files_with_issues"):
    oracle(_k, "SELECT repo, pr_number, file FROM vf", "vf")
oracle("pr_totals", """SELECT p.repo, p.pr_number, CAST(coalesce(sum(additions), 0) AS BIGINT) AS total_additions, CAST(coalesce(sum(deletions), 0) AS BIGINT) AS total_deletions,
 count(c.f) AS total_files FROM prs p LEFT JOIN changes c USING (repo, pr_number) GROUP BY 1, 2""", "prs", "changes")
cte("dec", """SELECT p.repo, p.pr_number, coalesce(tf, 0) AS total_files, CAST(coalesce(sum(n_violations), 0) AS BIGINT) AS total_violations,
 CAST(coalesce(sum(critical_count), 0) AS BIGINT) AS critical_count, CAST(coalesce(sum(error_count), 0) AS BIGINT) AS error_count,
 CAST(coalesce(sum(warning_count), 0) AS BIGINT) AS warning_count, CAST(coalesce(sum(info_count), 0) AS BIGINT) AS info_count,
 count(vf.file) AS files_with_issues,
 coalesce(bool_or(critical_count > 0) OR bool_or(n_violations >= 3) OR bool_or(complexity_count > 0), false) AS should_delegate,
 coalesce(bool_or(critical_count + error_count > 0), false) AS blocking
 FROM prs p LEFT JOIN (SELECT repo, pr_number, count(*) AS tf FROM files GROUP BY 1, 2) USING (repo, pr_number) LEFT JOIN vf USING (repo, pr_number) GROUP BY p.repo, p.pr_number, tf""", "prs", "files", "vf")
cte("dece", "SELECT *, CASE WHEN blocking THEN 'REQUEST_CHANGES' WHEN total_violations > 0 THEN 'COMMENT' ELSE 'APPROVE' END AS event FROM dec", "dec")
oracle("review_summary", "SELECT repo, pr_number, total_files, total_violations, critical_count, error_count, warning_count, info_count, files_with_issues FROM dec", "dec")
oracle("should_delegate", "SELECT repo, pr_number, should_delegate FROM dec", "dec")
oracle("review_event", "SELECT repo, pr_number, event FROM dece", "dece")
oracle("exit_status", "SELECT repo, pr_number, CAST(blocking AS INT) AS exit_status FROM dec", "dec")

# ------------------------------------------------------------------------------------------------ comments

cte("comments", f"SELECT *, CASE WHEN suggestion <> '' THEN message || {NL} || {NL} || '**Suggestion:** ' || suggestion ELSE message END AS body FROM v", "v")
oracle("review_comments", "SELECT file_ord, file, line, body, severity, rule_id, CAST(NULL AS VARCHAR) AS suggestion_code FROM comments", "comments")
BODY = f"CASE severity WHEN 'critical' THEN '🚨' WHEN 'error' THEN '❌' WHEN 'warning' THEN '⚠️' ELSE 'ℹ️' END || ' **' || upper(severity) || '** [' || rule_id || ']' || {NL} || {NL} || body"
oracle("review_comments_generated", f"""SELECT file_ord, rule_ord, seq, file, line, CASE WHEN severity IN ('critical', 'error') AND line % 2 = 0 THEN 'Please see ' || rule_id || ' in line ' || line || ', finding ' || seq
  || CASE WHEN suggestion <> '' THEN {NL} || {NL} || '**Suggestion:** ' || suggestion ELSE '' END ELSE body END AS body, severity, rule_id FROM comments""", "comments")
oracle("comment_body", f"""SELECT file_ord, line, rule_id, {BODY} || CASE WHEN rule_id = 'BP001' THEN {NL} || {NL} || '**Suggested fix:**' || {NL} || '```suggestion' || {NL} || 'except Exception as e:' || {NL} || '```' ELSE '' END AS formatted FROM comments""", "comments")
oracle("review_payload_rows", f"SELECT file_ord, file AS path, line, {BODY} AS body FROM comments", "comments")
oracle("review_payload", f"""SELECT d.repo, d.pr_number, d.event, c.file_ord, coalesce(c.comments, '[]') AS comments FROM dece d LEFT JOIN (
 SELECT repo, pr_number, file_ord, CAST(to_json(list({{'path': file, 'line': line, 'body': {BODY}}} ORDER BY rule_ord, line, seq)) AS VARCHAR) AS comments FROM comments GROUP BY 1, 2, 3) c USING (repo, pr_number)""", "dece", "comments")
oracle("violations_json", """SELECT file_ord, CAST(to_json({'rule_id': rule_id, 'rule_name': rule_name, 'category': category, 'severity': severity, 'file': file, 'line': line, 'column': "column",
 'message': message, 'suggestion': suggestion, 'code_snippet': code_snippet, 'confidence': confidence}) AS VARCHAR) AS violation_json FROM v""", "v")
_cat = """CASE WHEN regexp_matches(lower(t), 'security|vulnerability|injection|xss|secret') THEN 'security' WHEN regexp_matches(lower(t), 'style|naming|format|indent') THEN 'style'
 WHEN regexp_matches(lower(t), 'complexity|performance|memory|efficiency') THEN 'quality' ELSE 'best_practices' END"""
oracle("infer_category", f"SELECT doc_id, n AS line, {_cat} AS category FROM (SELECT doc_id, unnest(l) AS t, CAST(generate_subscripts(l, 1) AS INT) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
oracle("text_caps", "SELECT doc_id, " + ", ".join(f"substr(text, 1, {n}) AS cap_{n}" for n in (7, 100, 200, 500, 2000)) + " FROM documents")

# ------------------------------------------------------------------------------------------------- answers

_json = d.ANSWER_JSON.format(k="event_id", t="event_type")
_desc = "'Possible ' || CASE WHEN {k} % 3 = 0 THEN 'SQL injection' WHEN {k} % 3 = 1 THEN 'naming problem' ELSE 'memory use' END"
oracle("parse_model_json", f"""SELECT answer_id, k <> 3 AS is_json, CASE WHEN k = 3 THEN substr(response, 1, 500) ELSE 's' || answer_id END AS summary, CASE WHEN k = 3 THEN 0 ELSE 1 END AS n_issues,
 CASE WHEN k <> 3 THEN event_type END AS severity, CASE WHEN k <> 3 THEN CAST(answer_id % 9 AS INT) END AS line, CASE WHEN k <> 3 THEN {_desc.format(k='answer_id')} END AS description,
 CASE WHEN k <> 3 THEN 'fix ' || answer_id END AS suggestion FROM (SELECT event_id AS answer_id, event_type, event_id % 4 AS k, {d.ANSWER.format(k='event_id', json=_json)} AS response FROM events)""")
cte("ca", f"SELECT c.*, {d.CHUNK_KEY.format(f='c.f', start='start_line')} AS k FROM chunks3 c JOIN analyzable USING (f)", "chunks3", "analyzable")
oracle("model_issues", f"""SELECT repo, pr_number, f AS file_ord, 1000 + chunk_no AS rule_ord, 0 AS seq, 'LLM001' AS rule_id, 'llm_analysis' AS rule_name,
 CASE WHEN k % 3 = 0 THEN 'security' WHEN k % 3 = 1 THEN 'style' ELSE 'quality' END AS category,
 CASE k % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'critical' WHEN 2 THEN 'info' ELSE 'warning' END AS severity, filename AS file,
 CAST(CASE WHEN k % 9 <> 0 THEN start_line + k % 9 - 1 ELSE start_line END AS INT) AS line, 0 AS "column", {_desc.format(k='k')} AS message, 'fix ' || k AS suggestion,
 substr(code, 1, 200) AS code_snippet, CAST(0.8 AS DOUBLE) AS confidence, code FROM ca JOIN files USING (f) WHERE k % 4 <> 3""", "ca", "files")
oracle("equivalence_check", """SELECT event_id AS answer_id, CASE WHEN good AND c >= 8 THEN 'passed' WHEN good AND c >= 5 THEN 'warning' ELSE 'failed' END AS status,
 CASE WHEN good AND c >= 8 THEN 'Code appears semantically equivalent' WHEN good AND c >= 5 THEN 'Code may be semantically equivalent (low confidence)' ELSE 'Code may not be semantically equivalent' END AS message
 FROM (SELECT event_id, event_id % 10 AS c, event_id % 5 <> 4 AND event_id % 3 <> 0 AS good FROM events)""")

# ------------------------------------------------------------------------------------------------ rewrites

SECRET_NAME = "regexp_extract({t}, '(\\w*{w}\\w*)\\s*=\\s*[''\"][^''\"]+[''\"]', 1, 'i')"
_env = "CASE WHEN upper(nm) LIKE '%{u}' THEN upper(nm) ELSE upper(nm) || '_{u}' END"


def secret_cte(source):
    case = " ".join(f"WHEN {SECRET_NAME.format(t='t', w=w)} <> '' THEN {{'nm': {SECRET_NAME.format(t='t', w=w)}, 'u': '{w.upper()}'}}" for w in ("password", "api_key", "secret", "token"))
    inner = f"SELECT *, CASE {case} END AS m FROM {source}"
    return (f"SELECT * EXCLUDE (m), repeat(' ', length(t) - length(ltrim(t))) || m.nm || ' = os.environ.get(''' || env || ''')' AS fixed, "
            f"'Replaced hardcoded ' || m.nm || ' with os.environ.get(''' || env || ''')' AS change FROM "
            f"(SELECT *, CASE WHEN upper(m.nm) LIKE '%' || m.u THEN upper(m.nm) ELSE upper(m.nm) || '_' || m.u END AS env FROM ({inner}) WHERE m IS NOT NULL)")


cte("secretfix", secret_cte("src"), "src")
oracle("fix_secret", "SELECT f AS file_ord, n AS line, fixed, change FROM secretfix", "secretfix")
oracle("fix_bare_except", "SELECT f AS file_ord, n AS line, repeat(' ', length(t) - length(ltrim(t))) || 'except Exception as e:' AS fixed FROM src WHERE regexp_matches(t, '^\\s*except\\s*:')", "src")
cte("fixable", "SELECT v.* FROM v JOIN vf USING (repo, pr_number, file) WHERE n_violations >= 2 AND rule_id IN ('S002', 'BP001', 'SEC001')", "v", "vf")
oracle("fix_order", "SELECT repo, pr_number, file AS filename, CAST(row_number() OVER (PARTITION BY repo, pr_number, file ORDER BY line DESC, rule_ord, seq) - 1 AS INT) AS pos, line, rule_id FROM fixable", "fixable")
# Every name in these files is defined once and used nowhere else, so each rename stays on its own line.
OLD = f"CASE WHEN regexp_matches(s.t, '{DEF_RE}') THEN regexp_extract(s.t, '{DEF_RE}', 1) ELSE regexp_extract(s.t, '{CLASS_RE}', 1) END"
cte("linefix", f"""SELECT x.file_ord AS f, x.line AS n, x.rule_id, x.rule_ord, x.seq,
 CASE x.rule_id WHEN 'S002' THEN replace(s.t, {OLD}, regexp_extract(x.suggestion, 'Rename to ''(\\w+)''', 1)) WHEN 'BP001' THEN repeat(' ', length(s.t) - length(ltrim(s.t))) || 'except Exception as e:' ELSE sf.fixed END AS fixed,
 CASE x.rule_id WHEN 'S002' THEN 'Renamed ''' || {OLD} || ''' to ''' || regexp_extract(x.suggestion, 'Rename to ''(\\w+)''', 1) || '''' WHEN 'BP001' THEN 'Changed bare ''except:'' to ''except Exception as e:''' ELSE sf.change END AS change
 FROM fixable x JOIN src s ON s.f = x.file_ord AND s.n = x.line LEFT JOIN secretfix sf ON sf.f = s.f AND sf.n = s.n
 WHERE (x.rule_id <> 'BP001' OR x.seq = 0) AND (x.rule_id <> 'SEC001' OR sf.fixed IS NOT NULL)""", "fixable", "src", "secretfix")
cte("fixedlines", "SELECT s.f, s.n, coalesce(l.fixed, s.t) AS t FROM src s LEFT JOIN linefix l USING (f, n) WHERE s.f IN (SELECT f FROM linefix)", "src", "linefix")


def import_ctes(prefix, source):
    cte(prefix + "need", f"SELECT f FROM {source} GROUP BY f HAVING bool_or(contains(t, 'os.environ')) AND NOT bool_or(contains(t, 'import os'))", source)
    cte(prefix + "stop", f"SELECT f, min(n) AS stop FROM {source} WHERE NOT (t LIKE 'import %' OR t LIKE 'from %') AND trim(t) <> '' AND t NOT LIKE '#%' GROUP BY f", source)
    cte(prefix + "at", f"""SELECT f, coalesce(max(CASE WHEN (t LIKE 'import %' OR t LIKE 'from %') AND (stop IS NULL OR n < stop) THEN n END), 0) AS ins
 FROM {source} JOIN {prefix}need USING (f) LEFT JOIN {prefix}stop USING (f) GROUP BY f""", source, prefix + "need", prefix + "stop")
    cte(prefix + "final", f"""SELECT f, string_agg(t, {NL} ORDER BY n) AS code FROM (SELECT f, CAST(n AS DOUBLE) AS n, t FROM {source}
 UNION ALL SELECT f, ins + 0.5, 'import os' FROM {prefix}at) GROUP BY f""", source, prefix + "at")


import_ctes("s_", "src")
import_ctes("r_", "fixedlines")
oracle("ensure_import", "SELECT f AS file_ord, md5(code) AS code FROM s_final", "s_final")
cte("result", f"""SELECT fl.repo, fl.pr_number, f AS file_ord, fl.filename, c.content AS original_code, coalesce(r.code, c.content) AS refactored_code,
 CASE WHEN r.code IS NULL THEN 'No automatic fixes available' ELSE ch.changes || CASE WHEN a.ins IS NOT NULL THEN {NL} || 'Added: import os' ELSE '' END END AS changes_description,
 coalesce(ch.fixed_rules, '') AS violations_fixed, r.code IS NOT NULL AS success, CAST(NULL AS VARCHAR) AS error_message, ch.three
 FROM vf JOIN files fl ON fl.repo = vf.repo AND fl.pr_number = vf.pr_number AND fl.filename = vf.file JOIN content c USING (f) LEFT JOIN r_final r USING (f) LEFT JOIN r_at a USING (f)
 LEFT JOIN (SELECT f, string_agg(change, {NL} ORDER BY n DESC, rule_ord, seq) AS changes, string_agg(rule_id, ',' ORDER BY n DESC, rule_ord, seq) AS fixed_rules,
  array_to_string(list(rule_id ORDER BY n DESC, rule_ord, seq)[1:3], ', ') AS three FROM linefix GROUP BY f) ch USING (f)
 WHERE vf.n_violations >= 2""", "vf", "files", "content", "r_final", "r_at", "linefix")
oracle("apply_fixes", "SELECT * EXCLUDE (three) FROM result", "result")
_SECTIONS = {1: ("vf", "file", "### Files with Issues"), 2: ("result", "filename", "### 🔧 Automatic Refactoring Applied")}
_rows = " UNION ALL ".join(f"""SELECT DISTINCT repo, pr_number, {k} AS section, CAST(NULL AS VARCHAR) AS file, {NL} || '{h}' || {NL} AS markdown FROM {t} WHERE {w}
 UNION ALL SELECT DISTINCT repo, pr_number, {k} AS section, {c} AS file, '- `' || {c} || '`' AS markdown FROM {t} WHERE {w}"""
 for k, (t, c, h) in _SECTIONS.items() for w in ["true" if k == 1 else "success"])
oracle("summary_markdown", f"""SELECT repo, pr_number, 0 AS section, CAST(NULL AS VARCHAR) AS file, '## 🔍 AI Code Review Summary' || {NL} || {NL} || '| Metric | Count |' || {NL} || '|--------|-------|' || {NL}
 || '| Files Reviewed | ' || total_files || ' |' || {NL} || '| Total Issues | ' || total_violations || ' |' || {NL} || '| 🚨 Critical | ' || critical_count || ' |' || {NL}
 || '| ❌ Errors | ' || error_count || ' |' || {NL} || '| ⚠️ Warnings | ' || warning_count || ' |' || {NL} || '| ℹ️ Info | ' || info_count || ' |'
 || CASE WHEN total_violations = 0 THEN {NL} || {NL} || '✅ **No issues found! Great job!**' ELSE '' END AS markdown FROM dec
 UNION ALL {_rows}""", "dec", "vf", "result")
oracle("first_three_rules", "SELECT file_ord, 'Auto-fix: ' || three AS message FROM result WHERE success", "result")
oracle("refactor_results", """SELECT file_ord, CASE WHEN file_ord % 7 = 0 THEN 'Failed to fetch file' ELSE changes_description END AS changes_description, success AND file_ord % 7 <> 0 AS success,
 CASE WHEN file_ord % 7 = 0 THEN 'Could not fetch file contents' END AS error_message FROM result""", "result")
oracle("model_rewrites", f"""SELECT r.file_ord, md5(CASE WHEN use THEN plain_code ELSE refactored_code END) AS code,
 CASE WHEN NOT use THEN changes_description WHEN r.file_ord % 3 = 0 THEN 'e' || r.file_ord ELSE 'LLM refactoring applied' || {NL} || 'Added: import os' END AS changes_description,
 CASE WHEN use THEN ids ELSE violations_fixed END AS violations_fixed, success OR use AS success
 FROM (SELECT *, NOT success AND file_ord % 3 <> 2 AS use, CASE WHEN file_ord % 3 = 0 THEN 'value_' || file_ord || ' = 1' ELSE 'import os' || {NL} || 'value_' || file_ord || ' = os.environ' END AS plain_code FROM result) r
 JOIN (SELECT file_ord, string_agg(rule_id, ',' ORDER BY rule_ord, line, seq) AS ids FROM v GROUP BY 1) i ON i.file_ord = r.file_ord""", "result", "v")
oracle("violations_of_file", "SELECT v.file, v.rule_id, v.line FROM v WHERE file_ord IN (SELECT file_ord FROM result WHERE success)", "v", "result")
oracle("commit_plan", """SELECT repo, pr_number, filename, 'feature/' || pr_number AS branch, 'update' AS action, md5('h' || file_ord) AS existing_sha, 'Auto-fix: ' || three AS message, violations_fixed, refactored_code AS content
 FROM result WHERE success""", "result")
oracle("rollback_plan", """SELECT r.repo, r.pr_number, r.filename, 'feature/' || r.pr_number AS branch, md5('h' || file_ord) AS current_sha, c.content, l.sha AS rollback_sha,
 'Rollback: Revert ' || r.filename || ' to ' || substr(l.sha, 1, 7) AS message FROM result r JOIN last_commit l USING (repo, pr_number)
 JOIN contents c ON c.f = r.file_ord AND c.ref = 'base/' || r.pr_number WHERE success""", "result", "last_commit", "contents")
oracle("fix_naming", f"""SELECT x.f AS file_ord, x.line, md5(regexp_replace(c.content, '\\b' || {OLD.replace('s.t', 'w.t')} || '\\b', regexp_extract(x.suggestion, 'Rename to ''(\\w+)''', 1), 'g')) AS renamed
 FROM ({' UNION ALL '.join(rule_selects('wl', 'fns')['S002'])}) x JOIN wl w ON w.f = x.f AND w.n = x.line JOIN content c ON c.f = x.f""", "wl", "content")
oracle("handoff_snapshot", """SELECT a.repo, a.pr_number, a.ref AS branch, a.filename, CASE WHEN status <> 'removed' AND length(content) > 0 THEN content END AS original_code,
 CASE WHEN r.success THEN r.refactored_code END AS refactored_code, CAST(coalesce(vf.n_violations, 0) AS INT) AS n_violations, coalesce(k.n, 0) AS n_commits, coalesce(k.p, 0) AS n_rollback_points, k.last_point, 2 AS version, 'orchestrator@2026-01-01T00:00:00.000000+00:00' AS chain,
 '2026-01-01T00:00:00.000000+00:00' AS started_at FROM at_head a LEFT JOIN result r ON r.file_ord = a.f
 LEFT JOIN vf ON vf.repo = a.repo AND vf.pr_number = a.pr_number AND vf.file = a.filename
 LEFT JOIN (SELECT repo, pr_number, count(*) AS n, count(*) FILTER (commit_ord % 4 = 0) AS p, arg_max(sha, commit_ord) FILTER (commit_ord % 4 = 0) AS last_point FROM commits GROUP BY 1, 2) k
  ON k.repo = a.repo AND k.pr_number = a.pr_number""", "at_head", "result", "vf", "commits")
oracle("handoff_commits", """SELECT repo, pr_number, 'commits_made' AS kind, commit_ord AS ord, sha, 2 AS version FROM commits
 UNION ALL SELECT repo, pr_number, 'rollback_points', commit_ord, sha, 2 FROM commits WHERE commit_ord % 4 = 0""", "commits")

# ------------------------------------------------------------------------------------------------ prompts

_messages = f"(SELECT file_ord, string_agg('- Line ' || line || ': ' || message, {NL} ORDER BY rule_ord, line, seq) AS issues, array_to_string(list(message ORDER BY rule_ord, line, seq)[1:5], ', ') AS five FROM v GROUP BY 1)"
oracle("prompt_rows", f"""SELECT f AS file_ord, start_line, 'review' AS kind, 'Analyze this code focusing on security, bugs, best practices:' || {NL} || {NL} || '```' || {NL} || code || {NL} || '```' || {NL} || {NL}
 || 'Context: File: ' || filename || {NL} || {NL} || 'Provide your analysis as JSON.' AS prompt FROM chunks3 JOIN reviewed USING (f)
 UNION ALL SELECT file_ord, line, 'comment', 'Generate a review comment for this code issue:' || {NL} || {NL} || 'Violation type: ' || rule_name || {NL} || 'Message: ' || message || {NL} || {NL}
 || 'Code:' || {NL} || '```' || {NL} || code_snippet || {NL} || '```' || {NL} || {NL} || 'Write a helpful, professional comment.' FROM v WHERE severity IN ('critical', 'error')
 UNION ALL SELECT m.file_ord, 0, 'refactor', 'Refactor this code to fix:' || {NL} || {NL} || issues || {NL} || {NL} || 'Original code:' || {NL} || '```' || {NL} || content || {NL} || '```'
 FROM {_messages} m JOIN content c ON c.f = m.file_ord""", "chunks3", "reviewed", "v", "content")
oracle("first_five_messages", f"""SELECT m.file_ord, 'Analyze these two code versions and determine if they are semantically equivalent' || {NL}
 || '(produce the same behavior), accounting for the fact that the refactored version was modified to fix these issues:' || {NL} || five || {NL} || {NL} || 'ORIGINAL CODE:' || {NL} || '```python' || {NL}
 || substr(original_code, 1, 2000) || {NL} || '```' || {NL} || {NL} || 'REFACTORED CODE:' || {NL} || '```python' || {NL} || substr(refactored_code, 1, 2000) || {NL} || '```' || {NL} || {NL} || 'Respond with JSON:' || {NL}
 || '{{' || {NL} || '    "equivalent": true/false,' || {NL} || '    "confidence": 0.0-1.0,' || {NL} || '    "differences": ["list of behavioral differences if any"],' || {NL} || '    "assessment": "brief explanation"' || {NL} || '}}' AS prompt
 FROM {_messages} m JOIN result USING (file_ord) WHERE success""", "v", "result")

# -------------------------------------------------------------------------------------------------- events

_trig = """CAST(to_json({'timestamp': '2026-01-01T00:00:00.000000+00:00', 'event': 'rule_triggered', 'rule_id': rule_id, 'file': file, 'line': line, 'severity': severity}) AS VARCHAR)"""
oracle("review_log_write", f"SELECT DATE '2026-01-01' AS event_date, {_trig} AS value FROM v", "v")
oracle("review_log_scan", "SELECT TIMESTAMP '2026-01-01 00:00:00' AS timestamp, 'rule_triggered' AS event, rule_id, file, line, severity FROM v", "v")

# ------------------------------------------------------------------------------------- syntax-tree facts
# The modules are built from a four-line head and eight-line blocks, so every fact is known from the block number.

cte("blk", "SELECT f, n, (f + n) % 6 AS kind, 4 + (n - 1) * 8 AS b FROM raw", "raw")
cte("pyfiles", "SELECT *, filename LIKE '%.py' AND f % 9 <> 4 AS is_ast FROM files", "files")
cte("astblk", "SELECT * FROM blk JOIN pyfiles USING (f) WHERE is_ast", "blk", "pyfiles")
_ast_fn = [
    # kind, offset of def, offset of last line, name, class, params, returns, decorators, async, doc offset?, complexity, calls, body offset
    (0, 1, 7, "'fn_' || n", "NULL", "a,b,*args,**kwargs", "NULL", "", "false", "'\"\"\"Doc ' || n || '.\"\"\"'", 5, "helper", 2),
    (1, 2, 7, "'co_' || n", "NULL", "x,y", "'int'", "@cached", "true", "NULL", 5, "c.push,ctx,range", 3),
    (2, 4, 6, "'run'", "'Thing' || (n % 7)", "self,k", "NULL", "", "false", "NULL", 3, "self.go", 5),
    (2, 8, 8, "'size'", "'Thing' || (n % 7)", "self", "NULL", "@property", "false", "NULL", 1, "len", 8),
    (4, 1, 7, "'outer_' || n", "NULL", "q", "NULL", "", "false", "NULL", 5, "inner,logger.info,sum", 2),
    (4, 2, 3, "'inner'", "NULL", "z", "NULL", "", "false", "NULL", 1, "", 3),
    (5, 3, 3, "'say_' || n", "NULL", "", "NULL", "", "false", "NULL", 1, "print", 3),
]
cte("astfn", " UNION ALL ".join(
    f"SELECT f, filename, n, {name} AS name, CAST({cls} AS VARCHAR) AS class_name, CAST(b + {o} AS INT) AS start_line, CAST(b + {e} AS INT) AS end_line, CAST(b + {body} AS INT) AS body_start_line, "
    f"'{params}' AS parameters, CAST({ret} AS VARCHAR) AS return_type, '{dec}' AS decorators, {is_async} AS is_async, CAST({doc} AS VARCHAR) AS docstring, {cx} AS complexity, '{calls}' AS calls FROM astblk WHERE kind = {kind}"
    for kind, o, e, name, cls, params, ret, dec, is_async, doc, cx, calls, body in _ast_fn), "astblk")
cte("mline", """SELECT f, filename, CAST(4 + i AS INT) AS line, kind, n, i - (n - 1) * 8 AS o FROM (SELECT *, (n - 1) * 8 + unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS i FROM blk) JOIN pyfiles USING (f) WHERE NOT is_ast""", "blk", "pyfiles")
cte("rxfn", """SELECT f, filename, n, CASE WHEN kind = 0 THEN 'fn_' || n WHEN kind = 1 THEN 'co_' || n WHEN kind = 2 AND o = 4 THEN 'run' WHEN kind = 2 THEN 'size'
 WHEN kind = 4 AND o = 1 THEN 'outer_' || n WHEN kind = 4 THEN 'inner' ELSE 'say_' || n END AS name, CAST(NULL AS VARCHAR) AS class_name, line AS start_line, line AS end_line, 0 AS body_start_line,
 '' AS parameters, CAST(NULL AS VARCHAR) AS return_type, '' AS decorators, kind = 1 AS is_async, CAST(NULL AS VARCHAR) AS docstring, 1 AS complexity, '' AS calls
 FROM mline WHERE (kind, o) IN ((0, 1), (1, 2), (2, 4), (2, 8), (4, 1), (4, 2), (5, 3))
 UNION ALL SELECT f, filename, 0, 'broken', NULL, l, l, 0, '', NULL, '', false, NULL, 1, '' FROM (SELECT f, filename, CAST(5 + max(n) * 8 AS INT) AS l FROM blk JOIN pyfiles USING (f) WHERE f % 9 = 4 GROUP BY 1, 2)""", "mline", "blk", "pyfiles")
cte("pyfn", "SELECT * FROM astfn UNION ALL SELECT * FROM rxfn", "astfn", "rxfn")
oracle("facts_functions", "SELECT f AS file_ord, * EXCLUDE (f, n) FROM pyfn", "pyfn")
oracle("ast_complexity", "SELECT f AS file_ord, filename, name, start_line, complexity FROM pyfn", "pyfn")
oracle("complex_functions", "SELECT f AS file_ord, filename, name, complexity FROM pyfn WHERE complexity > 4", "pyfn")
oracle("long_functions", "SELECT f AS file_ord, filename, name, start_line, end_line FROM pyfn WHERE end_line - start_line + 1 > 6", "pyfn")
oracle("facts_calls", "SELECT f AS file_ord, filename, name AS caller, start_line AS line, unnest(string_split(calls, ',')) AS callee FROM pyfn WHERE calls <> ''", "pyfn")
cte("pycls", """SELECT f, filename, n, 'Thing' || (n % 7) AS name, CAST(b + 1 AS INT) AS start_line, CAST(b + CASE WHEN is_ast THEN 8 ELSE 1 END AS INT) AS end_line, CASE WHEN is_ast THEN '\"\"\"Thing ' || n || '.\"\"\"' END AS docstring,
 CASE WHEN is_ast THEN 'Base' ELSE '' END AS bases, CASE WHEN is_ast THEN 'run,size' ELSE '' END AS methods, '' AS decorators FROM blk JOIN pyfiles USING (f) WHERE kind = 2""", "blk", "pyfiles")
oracle("facts_classes", "SELECT f AS file_ord, * EXCLUDE (f, n) FROM pycls", "pycls")
cte("pyimp", """SELECT f, filename, 'os' AS module, '' AS names, CAST(NULL AS VARCHAR) AS alias, 2 AS line, false AS is_from_import FROM pyfiles
 UNION ALL SELECT f, filename, 'json', '', CASE WHEN is_ast THEN 'js' END, 3, false FROM pyfiles
 UNION ALL SELECT f, filename, 'pkg.mod' || (f % 7), CASE WHEN is_ast THEN 'alpha,beta' ELSE '' END, NULL, 4, true FROM pyfiles
 UNION ALL SELECT f, filename, 'fast_' || n, '', NULL, CAST(b + 7 AS INT), false FROM astblk WHERE kind = 3""", "pyfiles", "astblk")
oracle("facts_imports", "SELECT f AS file_ord, * EXCLUDE (f) FROM pyimp", "pyimp")
oracle("facts_globals", """SELECT f AS file_ord, filename, name, CAST(b + o AS INT) AS line FROM (
 SELECT *, 'LIMIT_' || n AS name, 1 AS o FROM astblk WHERE kind = 3 UNION ALL SELECT *, 'typed_' || n, 3 FROM astblk WHERE kind = 3 UNION ALL SELECT *, 'a_' || n, 4 FROM astblk WHERE kind = 3
 UNION ALL SELECT *, 'fast_' || n, 8 FROM astblk WHERE kind = 3 UNION ALL SELECT *, 'TEXT_' || n, 1 FROM astblk WHERE kind = 5)""", "astblk")
oracle("file_complexity_score", "SELECT p.f AS file_ord, p.filename, CAST(coalesce(sum(a.complexity), 0) AS INT) AS complexity_score FROM pyfiles p LEFT JOIN astfn a USING (f) GROUP BY 1, 2", "pyfiles", "astfn")
# Lines that are neither blank nor comments per block kind: 0..5.
oracle("facts_route", """SELECT f AS file_ord, filename, CASE WHEN is_ast THEN 'ast' ELSE 'regex' END AS source, CAST(4 + 8 * count(*) + CASE WHEN f % 9 = 4 THEN 1 ELSE 0 END AS INT) AS loc,
 CAST(4 + sum(CASE kind WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 8 WHEN 3 THEN 7 WHEN 4 THEN 7 ELSE 4 END) + CASE WHEN f % 9 = 4 THEN 1 ELSE 0 END AS INT) AS sloc FROM blk JOIN pyfiles USING (f) GROUP BY f, filename, is_ast""", "blk", "pyfiles")
cte("pylines", "SELECT f, filename, CAST(unnest(range(1, 5 + k)) AS INT) AS line FROM (SELECT f, filename, 8 * count(*) + CASE WHEN f % 9 = 4 THEN 1 ELSE 0 END AS k FROM blk JOIN pyfiles USING (f) GROUP BY 1, 2)", "blk", "pyfiles")
oracle("function_at_line", """SELECT l.f AS file_ord, l.filename, l.line, arg_min(p.name, (p.class_name IS NOT NULL, p.start_line)) AS function_name FROM pylines l
 LEFT JOIN pyfn p ON p.f = l.f AND l.line BETWEEN p.start_line AND p.end_line GROUP BY 1, 2, 3""", "pylines", "pyfn")
cte("pyasked", "SELECT * FROM pylines WHERE line % 3 = 0 UNION ALL SELECT f, filename, 1048576 FROM pyfiles", "pylines", "pyfiles")
oracle("function_at_position", """SELECT l.f AS file_ord, l.filename, l.line, arg_min(p.name, (p.class_name IS NOT NULL, p.start_line)) AS function_name FROM pyasked l
 LEFT JOIN pyfn p ON p.f = l.f AND l.line BETWEEN p.start_line AND p.end_line GROUP BY 1, 2, 3""", "pyasked", "pyfn")
oracle("class_at_position", """SELECT l.f AS file_ord, l.filename, l.line, arg_min(p.name, p.start_line) AS class_name FROM pyasked l
 LEFT JOIN pycls p ON p.f = l.f AND l.line BETWEEN p.start_line AND p.end_line GROUP BY 1, 2, 3""", "pyasked", "pycls")
oracle("class_at_line", """SELECT l.f AS file_ord, l.filename, l.line, arg_min(p.name, p.start_line) AS class_name FROM pylines l
 LEFT JOIN pycls p ON p.f = l.f AND l.line BETWEEN p.start_line AND p.end_line GROUP BY 1, 2, 3""", "pylines", "pycls")

# -------------------------------------------------------------------------------------------- verification
# What each rewrite did to the blocks: f % 4 = 0 drops every fifth block, 1 drops an import, 2 adds a heavy function,
# 3 renames words and calls; f % 8 = 6 also breaks the syntax.

cte("py", "SELECT *, filename LIKE '%.py' AS is_py, f % 8 = 6 AS is_broken FROM files", "files")
cte("names_o", """SELECT DISTINCT f, 'functions' AS kind, name FROM (
  SELECT f, n, unnest(CASE kind WHEN 0 THEN ['fn_' || n] WHEN 1 THEN ['co_' || n] WHEN 4 THEN ['outer_' || n, 'inner'] WHEN 5 THEN ['say_' || n] WHEN 2 THEN CASE WHEN is_py THEN [] ELSE ['run', 'size'] END ELSE [] END) AS name
  FROM blk JOIN py USING (f))
 UNION ALL SELECT f, 'classes', 'Thing' || (n % 7) FROM blk WHERE kind = 2
 UNION ALL SELECT f, 'imports', unnest(['os', 'json', 'pkg.mod' || (f % 7)]) FROM py UNION ALL SELECT f, 'imports', 'fast_' || n FROM blk JOIN py USING (f) WHERE kind = 3 AND is_py""", "blk", "py")
# The rewritten text of a broken .py file is read by pattern.
cte("names_r", """SELECT DISTINCT f, 'functions' AS kind, name FROM (
  SELECT f, n, unnest(CASE kind WHEN 0 THEN ['fn_' || n] WHEN 1 THEN ['co_' || n] WHEN 4 THEN ['outer_' || n, 'inner'] WHEN 5 THEN ['say_' || n] WHEN 2 THEN CASE WHEN is_py AND NOT is_broken THEN [] ELSE ['run', 'size'] END ELSE [] END) AS name
  FROM blk JOIN py USING (f) WHERE f % 4 <> 0 OR n % 5 <> 0
  UNION ALL SELECT f, 0, 'heavy' FROM py WHERE f % 4 = 2 UNION ALL SELECT f, 0, 'bad' FROM py WHERE is_broken)
 UNION ALL SELECT f, 'classes', 'Thing' || (n % 7) FROM blk WHERE kind = 2 AND (f % 4 <> 0 OR n % 5 <> 0)
 UNION ALL SELECT f, 'imports', unnest(CASE WHEN f % 4 = 1 THEN ['json', 'pkg.mod' || (f % 7)] ELSE ['os', 'json', 'pkg.mod' || (f % 7)] END) FROM py
 UNION ALL SELECT f, 'imports', 'fast_' || n FROM blk JOIN py USING (f) WHERE kind = 3 AND is_py AND NOT is_broken AND (f % 4 <> 0 OR n % 5 <> 0)""", "blk", "py")
cte("removed", "SELECT * FROM names_o EXCEPT SELECT * FROM names_r", "names_o", "names_r")
cte("added", "SELECT * FROM names_r EXCEPT SELECT * FROM names_o", "names_o", "names_r")
for _k, _t in (("removed_names", "removed"), ("added_names", "added")):
    oracle(_k, f"SELECT repo, pr_number, f AS file_ord, filename, kind, name FROM {_t} JOIN files USING (f)", _t, "files")
_score = "CASE kind WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 4 THEN 6 WHEN 5 THEN 1 ELSE 0 END"
cte("pair", f"""SELECT py.*, CAST(CASE WHEN is_py THEN so ELSE 0 END AS INT) AS of_score, CAST(CASE WHEN is_py AND NOT is_broken THEN sr + CASE WHEN f % 4 = 2 THEN 31 ELSE 0 END ELSE 0 END AS INT) AS rf_score FROM py JOIN (SELECT f, sum({_score}) AS so, sum(CASE WHEN f % 4 <> 0 OR n % 5 <> 0 THEN {_score} ELSE 0 END) AS sr FROM blk GROUP BY f) USING (f)""", "py", "blk")
cte("pairtext_raw", """SELECT f, n, kind, regexp_replace(q, '[^A-Za-z0-9 ,]', '', 'g') AS q FROM blk JOIN raw USING (f, n)""", "blk", "raw")
_stems = ("auth", "authentication"), ("verify", "verification"), ("encrypt", "encryption"), ("decrypt", "decryption"), ("hash", "hashing"), ("sanitize", "sanitization"), ("validate", "validation")
_kept = "(f % 4 <> 0 OR n % 5 <> 0)"
_text = "CASE WHEN kind = 5 THEN q WHEN kind = 3 THEN 'validate' ELSE '' END"
_after = "CASE WHEN f % 4 = 3 THEN replace(" + _text + ", 'validate', 'check') ELSE " + _text + " END"
cte("crit", "SELECT f, array_to_string([x for x in ["
       + ", ".join(f"CASE WHEN bool_or(regexp_matches({_text}, '\\b{w}', 'i')) AND NOT bool_or({_kept} AND regexp_matches({_after}, '\\b{w}', 'i')) THEN 'All {label} code was removed' END" for w, label in _stems)
       + f", CASE WHEN bool_or(kind = 3) AND NOT bool_or(kind = 3 AND {_kept}) THEN 'All try/except blocks were removed' END"
       + f", CASE WHEN bool_or(kind = 4) AND NOT bool_or(kind = 4 AND {_kept} AND f % 4 <> 3) THEN 'All logging statements were removed' END"
       + "] if x IS NOT NULL], '; ') AS issues FROM pairtext_raw GROUP BY f", "pairtext_raw")
oracle("verify_critical", "SELECT f AS file_ord, issues, CASE WHEN issues = '' THEN 'passed' ELSE 'failed' END AS status FROM crit", "crit")

_rm = "(SELECT f, kind, '{{' || string_agg('''' || name || '''', ', ' ORDER BY name) || '}}' AS s, to_json(list(name ORDER BY name)) AS j FROM {t} GROUP BY 1, 2)"
cte("struct", f"""SELECT p.*, rf.s AS rm_f, rc.s AS rm_c, ri.s AS rm_i, ri.j AS rm_ij, rf_score > of_score * 1.5 AS grew FROM pair p
 LEFT JOIN {_rm.format(t='removed')} rf ON rf.f = p.f AND rf.kind = 'functions' LEFT JOIN {_rm.format(t='removed')} rc ON rc.f = p.f AND rc.kind = 'classes'
 LEFT JOIN {_rm.format(t='removed')} ri ON ri.f = p.f AND ri.kind = 'imports'""", "pair", "removed")
cte("checks3", """SELECT *, CASE WHEN rm_f IS NOT NULL OR rm_c IS NOT NULL OR grew THEN 'warning' ELSE 'passed' END AS st, CASE WHEN rm_i IS NOT NULL THEN 'warning' ELSE 'passed' END AS im,
 CASE WHEN issues <> '' THEN 'failed' ELSE 'passed' END AS cr FROM struct JOIN crit USING (f)""", "struct", "crit")
oracle("verify_syntax", "SELECT f AS file_ord, 'syntax_validation' AS name, CASE WHEN is_broken THEN 'failed' ELSE 'passed' END AS status FROM py", "py")
oracle("verify_structure", """SELECT f AS file_ord, st AS status, CASE st WHEN 'warning' THEN 'AST structure changed significantly' ELSE 'AST structure is reasonably preserved' END AS message,
 CASE WHEN st = 'warning' THEN CAST(to_json([x for x in ['Functions removed/renamed: ' || rm_f, 'Classes removed/renamed: ' || rm_c, CASE WHEN grew THEN 'Complexity increased significantly: ' || of_score || ' -> ' || rf_score END] if x IS NOT NULL]) AS VARCHAR) END AS issues,
 CASE WHEN st = 'passed' THEN CAST(of_score AS VARCHAR) END AS original_complexity, CASE WHEN st = 'passed' THEN CAST(coalesce(nf, 0) AS VARCHAR) END AS refactored_functions
 FROM checks3 LEFT JOIN (SELECT f, count(*) AS nf FROM names_r WHERE kind = 'functions' GROUP BY 1) USING (f) WHERE NOT is_broken""", "checks3", "names_r")
oracle("verify_imports", """SELECT f AS file_ord, im AS status, CASE im WHEN 'warning' THEN 'Some imports were removed: ' || rm_i ELSE 'Import integrity maintained' END AS message,
 CASE im WHEN 'warning' THEN CAST(rm_ij AS VARCHAR) END AS removed FROM checks3 WHERE NOT is_broken""", "checks3")
oracle("verification_checks", """SELECT f AS file_ord, 0 AS check_no, 'syntax_validation' AS name, CASE WHEN is_broken THEN 'failed' ELSE 'passed' END AS status FROM checks3
 UNION ALL SELECT f, 1, 'ast_structure', st FROM checks3 WHERE NOT is_broken UNION ALL SELECT f, 2, 'import_integrity', im FROM checks3 WHERE NOT is_broken
 UNION ALL SELECT f, 3, 'critical_changes', cr FROM checks3 WHERE NOT is_broken""", "checks3")
cte("vr", """SELECT *, NOT is_broken AND cr = 'passed' AS passed, CASE WHEN st = 'warning' THEN 1 ELSE 0 END + CASE WHEN im = 'warning' THEN 1 ELSE 0 END AS warns FROM checks3""", "checks3")
oracle("verification_rollup", """SELECT f AS file_ord, passed, passed AS safe_to_commit, passed AND warns > 0 AS requires_human_review,
 CASE WHEN is_broken THEN 'Refactored code has syntax errors' WHEN NOT passed THEN 'Verification failed: 1 checks failed' WHEN warns > 0 THEN 'Verification passed with ' || warns || ' warnings' ELSE 'All verification checks passed' END AS overall_message FROM vr""", "vr")
cte("vs", """SELECT *, is_broken IS FALSE AND cr = 'passed' AND sem <> 'failed' AS fine, CASE WHEN cr = 'passed' THEN 0 ELSE 1 END + CASE WHEN sem = 'failed' THEN 1 ELSE 0 END AS bad, warns + CASE WHEN sem = 'warning' THEN 1 ELSE 0 END AS w
 FROM (SELECT *, CASE WHEN f % 7 = 0 THEN 'warning' WHEN good AND f % 10 >= 8 THEN 'passed' WHEN good AND f % 10 >= 5 THEN 'warning' ELSE 'failed' END AS sem FROM (SELECT *, f % 5 <> 4 AND f % 3 <> 0 AS good FROM vr))""", "vr")
oracle("verification_answers", """SELECT f AS file_ord, fine AS passed, fine AS safe_to_commit, NOT is_broken AND (sem = 'warning' OR (fine AND w > 0)) AS requires_human_review,
 CASE WHEN is_broken THEN 'Refactored code has syntax errors' WHEN NOT fine THEN 'Verification failed: ' || bad || ' checks failed' WHEN w > 0 THEN 'Verification passed with ' || w || ' warnings' ELSE 'All verification checks passed' END AS overall_message FROM vs""", "vs")
oracle("verification_all", "SELECT p.repo, p.pr_number, coalesce(bool_and(passed), true) AS verification_passed FROM prs p LEFT JOIN vr USING (repo, pr_number) GROUP BY 1, 2", "prs", "vr")
# ----------------------------------------------------------------------------------------------- test logs

cte("runs_ci", """SELECT o_orderkey AS run_id, o_custkey AS pr_number, o_orderkey % 6 AS k, CAST(o_orderkey % 17 AS INT) AS a, CAST(o_orderkey % 5 AS INT) AS b, CAST(o_orderkey % 3 AS INT) AS c FROM orders""")
cte("suite", """SELECT run_id, pr_number, k, CASE WHEN k = 3 THEN 'error' WHEN k IN (1, 5) THEN 'passed' ELSE 'failed' END AS status,
 CASE WHEN k IN (0, 1, 2, 5) THEN a ELSE 0 END AS passed, CASE WHEN k IN (0, 2, 4) THEN b ELSE 0 END AS failed, CASE WHEN k = 0 THEN c ELSE 0 END AS errors, 0 AS skipped,
 CASE k WHEN 0 THEN (b + 0.5) * 1000 WHEN 1 THEN (c + 0.25) * 1000 WHEN 2 THEN a * 1000.0 ELSE 0 END::DOUBLE AS duration_ms,
 CASE WHEN k = 0 THEN run_id % 101 END::DOUBLE AS coverage_percent FROM runs_ci""", "runs_ci")
cte("suites2", "SELECT *, passed + failed + errors AS total_tests, CASE WHEN passed + failed + errors = 0 THEN 1.0 ELSE passed::DOUBLE / (passed + failed + errors) END AS success_rate FROM suite", "suite")
oracle("pytest_suites", "SELECT * EXCLUDE (k, pr_number) FROM suites2 WHERE k < 4", "suites2")
oracle("unittest_suites", "SELECT * EXCLUDE (k, pr_number) FROM suites2 WHERE k >= 4", "suites2")
oracle("success_rate", "SELECT run_id, success_rate FROM suites2", "suites2")
oracle("tests_passed", "SELECT run_id, status, passed, total_tests, passed = total_tests AS tests_passed FROM suites2", "suites2")
oracle("pytest_results", """SELECT run_id, 0 AS test_no, 'tests/test_a.py::test_' || run_id AS name, 'passed' AS status FROM runs_ci WHERE k = 0
 UNION ALL SELECT run_id, 1, 'TestB::test_x', 'failed' FROM runs_ci WHERE k = 0
 UNION ALL SELECT run_id, 0, 'tests/test_c.py::test_y', 'passed' FROM runs_ci WHERE k = 1
 UNION ALL SELECT run_id, 0, 'tests/test_d.py::test_z', 'error' FROM runs_ci WHERE k = 2 UNION ALL SELECT run_id, 1, 'tests/test_e.py::test_w', 'skipped' FROM runs_ci WHERE k = 2""", "runs_ci")
cte("tree", """SELECT repo, unnest(list_filter_null) AS path FROM (SELECT repo, [x for x in [filename, CASE WHEN f % 3 = 0 THEN 'tests/test_s' || f || '.py' END, CASE WHEN f % 5 = 0 THEN 's' || f || '_test.py' END,
 CASE WHEN f % 5 = 2 THEN 'tests/lib/core/test_m' || f || '.py' END, CASE WHEN f % 7 = 0 THEN '.venv/test_x' || f || '.py' END, CASE WHEN f % 100 = 0 THEN 'requirements.txt' END] if x IS NOT NULL] AS list_filter_null FROM files)""", "files")
cte("found", "SELECT repo, path, CASE WHEN path LIKE '%\\_test.py' ESCAPE '\\' THEN '*_test.py' ELSE 'test_*.py' END AS pattern FROM tree WHERE path NOT LIKE '.venv%' AND regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)\\.py$')", "tree")
oracle("discover_tests", "SELECT * FROM found", "found")
cte("wide", "SELECT DISTINCT repo, path FROM tree WHERE path LIKE 'tests/%' AND regexp_matches(path, '/test_[^/]*\\.py$')", "tree")
cte("own", """SELECT DISTINCT repo, pr_number, path FROM (SELECT repo, pr_number, regexp_extract(filename, '([^/]*?)(\\.[^./]*)?$', 1) || '_test.py' AS path FROM files WHERE status <> 'removed') JOIN (SELECT DISTINCT repo, path FROM tree) USING (repo, path)""", "files", "tree")
oracle("related_tests", "SELECT repo, pr_number, path FROM own UNION ALL SELECT repo, NULL, path FROM wide", "own", "wide")
oracle("detect_framework", "SELECT repo, bool_or(path IN ('pytest', 'conftest.py', 'pytest.ini', 'pyproject.toml')) AS has_marker_file, bool_or(path = 'requirements.txt') AS has_requirements, 'pytest' AS framework, any_value(named) AS requirements_name_pytest FROM tree LEFT JOIN (SELECT repo, bool_or(f % 200 = 0) AS named FROM files WHERE f % 100 = 0 GROUP BY 1) USING (repo) GROUP BY 1", "tree", "files")
cte("torun", """SELECT repo, pr_number, CASE WHEN r > 0 THEN 'related' WHEN d > 0 THEN 'discovered' ELSE 'none' END AS source, CASE WHEN r > 0 THEN r ELSE d END AS n_tests, CASE WHEN r = 0 AND d = 0 THEN 'no_tests' END AS status FROM (
 SELECT p.repo, p.pr_number, CASE WHEN c.pr_number IS NULL THEN 0 ELSE coalesce(o.k, 0) + coalesce(w.k, 0) END AS r, coalesce(f.k, 0) AS d FROM prs p
 LEFT JOIN (SELECT DISTINCT repo, pr_number FROM files WHERE status <> 'removed') c USING (repo, pr_number) LEFT JOIN (SELECT repo, pr_number, count(*) AS k FROM own GROUP BY 1, 2) o USING (repo, pr_number)
 LEFT JOIN (SELECT repo, count(*) AS k FROM wide GROUP BY 1) w ON w.repo = p.repo LEFT JOIN (SELECT repo, count(*) AS k FROM found GROUP BY 1) f ON f.repo = p.repo)""", "prs", "files", "own", "wide", "found")
oracle("tests_to_run", "SELECT * FROM torun", "torun")
oracle("test_list", """SELECT repo, pr_number, source, path FROM own JOIN (SELECT repo, pr_number, source FROM torun WHERE source = 'related') USING (repo, pr_number)
 UNION ALL SELECT repo, NULL, source, path FROM wide JOIN (SELECT DISTINCT repo, source FROM torun WHERE source = 'related') USING (repo)
 UNION ALL SELECT repo, NULL, source, path FROM found JOIN (SELECT DISTINCT repo, source FROM torun WHERE source = 'discovered') USING (repo)""", "own", "wide", "found", "torun")

# ------------------------------------------------------------------------------------------------- routing
# Rewrites are the derived pairs of the delegated pull requests, so whether they verify follows from the document id.

cte("lasttest", "SELECT repo, pr_number, arg_max({'passed': passed, 'total': total_tests}, run_id) AS t FROM (SELECT *, " + REPO.format(pr="pr_number") + " AS repo FROM suites2) GROUP BY 1, 2", "suites2")
cte("rewritten", "SELECT fl.* FROM files fl JOIN dec USING (repo, pr_number) WHERE should_delegate", "files", "dec")
cte("perpr", "SELECT r.repo, r.pr_number, count(*) AS n, bool_and(vr.passed) AS fine FROM rewritten r JOIN vr USING (f) GROUP BY 1, 2", "rewritten", "vr")
_route = """SELECT repo, pr_number, refactor, n_rewritten, verify, verification_passed, test, tests_passed, rollback, rollback AND sha IS NOT NULL AS rollback_performed,
 refactor AND n_rewritten > 0 AND NOT (rollback AND sha IS NOT NULL) AS refactoring_performed, sha
 FROM (SELECT *, verify AND {rollback} AND NOT (verification_passed AND tests_passed) AS rollback
 FROM (SELECT *, CASE WHEN test AND n_rewritten > 0 THEN coalesce(t.passed = t.total, true) ELSE true END AS tests_passed
 FROM (SELECT *, verify AND verification_passed AS test
 FROM (SELECT p.repo, p.pr_number, should_delegate AS refactor, should_delegate AS verify, coalesce(n, 0) AS n_rewritten, CASE WHEN should_delegate THEN coalesce(fine, true) ELSE true END AS verification_passed, t, sha
  FROM dec p LEFT JOIN perpr USING (repo, pr_number) LEFT JOIN lasttest USING (repo, pr_number) LEFT JOIN last_commit USING (repo, pr_number)))))"""
for _name, _on in (("route", "true"), ("routekept", "false")):
    cte(_name, _route.format(rollback=_on), "dec", "perpr", "lasttest", "last_commit")
oracle("review_route", "SELECT * FROM route", "route")
oracle("review_route_kept", "SELECT * FROM routekept", "routekept")
for _k, _t in (("mark_refactored", "route"), ("mark_refactored_kept", "routekept")):
    oracle(_k, f"SELECT r.repo, r.pr_number, r.filename AS file FROM rewritten r JOIN {_t} USING (repo, pr_number) WHERE refactoring_performed", "rewritten", _t)


def _event(step, event, source, fields="", where="true", file_ord="0", rule_ord="0", line="0", seq="0"):
    rest = f", {fields}" if fields else ""
    return (f"SELECT repo, pr_number, {step} AS step, CAST({file_ord} AS BIGINT) AS file_ord, CAST({rule_ord} AS INT) AS rule_ord, CAST({line} AS INT) AS line, CAST({seq} AS INT) AS seq, '{event}' AS event, "
            f"CAST(to_json({{'timestamp': '2026-01-01T00:00:00.000000+00:00', 'event': '{event}'{rest}}}) AS VARCHAR) AS value FROM {source} WHERE {where}")


_found = {"file_ord": "file_ord", "rule_ord": "rule_ord", "line": "line", "seq": "seq"}
_comment = "'file': file, 'line': line, 'severity': severity, 'rule_id': rule_id, 'body': body"
oracle("review_events", " UNION ALL ".join([
    _event(1, "review_started", "prs", "'pr': pr_number"),
    _event(2, "pr_fetched", "dec", "'files_count': total_files"),
    _event(3, "rollback_point_created", "route", "'sha': substr(sha, 1, 7), 'full_sha': sha", "sha IS NOT NULL"),
    _event(4, "rule_triggered", "v", "'rule_id': rule_id, 'file': file, 'line': line, 'severity': severity", **_found),
    _event(5, "comment_generated", "comments", _comment, **_found),
    _event(6, "delegation", "route", "'target': 'refactor_agent'", "refactor"),
    _event(7, "refactor_applied", "rewritten", "'file': filename", file_ord="f"),
    _event(8, "verification", "(SELECT r.*, vr.passed FROM rewritten r JOIN vr USING (f))", "'file': filename, 'passed': passed", file_ord="f"),
    _event(9, "tests", "(SELECT * FROM route JOIN lasttest USING (repo, pr_number))", "'passed': t.passed, 'total': t.total", "test AND n_rewritten > 0"),
    _event(10, "rollback", "(SELECT r.* FROM rewritten r JOIN route USING (repo, pr_number) WHERE rollback_performed)", "'success': true, 'file': filename", file_ord="f"),
    _event(11, "comment_post_attempt", "comments", _comment, **_found),
    _event(12, "comments_posted", "dec", "'count': total_violations, 'success': true"),
    _event(13, "review_completed", "dec", "'total_violations': total_violations, 'comments_posted': total_violations"),
]), "prs", "dec", "route", "v", "comments", "rewritten", "vr", "lasttest")
