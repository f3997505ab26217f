"""Deterministic rewrites: ordered fixes of one file, folded into what changes, and written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.functions import text as tx
from pullscan.functions.once import compute_once, let
from pullscan.model import PR_KEY
from pullscan.operators.answers import parse_refactoring
from pullscan.rules.checks import BARE_EXCEPT, CLASS, DEF

# Which rules have a fix, and the assignments recognised as secrets, in order.
FIXABLE_RULES = ("S002", "BP001", "SEC001")
SECRETS = tuple(
    (rf"({tx.WORD}*{word}{tx.WORD}*){tx.WS}*={tx.WS}*['\"][^'\"]+['\"]", word.upper())
    for word in ("password", "api_key", "secret", "token")
)


def new_name_of(suggestion: Column) -> Column:
    return F.regexp_extract(suggestion, rf"(?U)Rename to '({tx.WORD}+)'", 1)


def defined_name(line: Column) -> Column:
    """The function or class name a line defines, '' when it defines none."""
    function = F.regexp_extract(line, DEF, 1)
    return F.when(function != "", function).otherwise(F.regexp_extract(line, CLASS, 1))


def rename(code: Column, old: Column, new: Column) -> Column:
    """Whole-word replacement in a whole text."""
    return F.regexp_replace(code, F.concat(F.lit("(?U)" + tx.NOT_AFTER_WORD), old, F.lit(tx.NOT_BEFORE_WORD)), new)


def bare_except_fix(line: Column) -> Column:
    """The replacement line, or null when the line is no bare except clause."""
    return F.when(
        line.rlike(BARE_EXCEPT), F.concat(F.repeat(F.lit(" "), tx.indent_of(line)), F.lit("except Exception as e:"))
    )


def secret_fix(line: Column) -> Column:
    """struct<line, change> of the first assignment pattern found, or null."""
    none = F.lit(None).cast("struct<line:string,change:string>")
    out = none
    for pattern, suffix in reversed(SECRETS):
        name = F.regexp_extract(line, tx.FLAGS_NOCASE + pattern, 1)

        out = F.coalesce(let(name, _lookup(line, suffix)), out)
    return out


def _lookup(line: Column, suffix: str):
    """The replacement for a secret held in the variable ``n``; null for no variable."""

    def build(n):
        env = F.when(F.upper(n).endswith(suffix), F.upper(n)).otherwise(F.concat(F.upper(n), F.lit("_" + suffix)))
        call = F.concat(F.lit("os.environ.get('"), env, F.lit("')"))
        return F.when(
            n != "",
            F.struct(
                F.concat(F.repeat(F.lit(" "), tx.indent_of(line)), n, F.lit(" = "), call).alias("line"),
                F.concat(F.lit("Replaced hardcoded "), n, F.lit(" with "), call).alias("change"),
            ),
        )

    return build


def ensure_import(code: Column) -> Column:
    """Insert ``import os`` after the leading import block when the text uses ``os.environ`` without it."""

    def starts_import(t):
        return t.startswith("import ") | t.startswith("from ")

    def insert(lines):
        # First line that ends the leading block; 0 when the block is the whole file.
        stop = F.array_position(
            F.transform(lines, lambda t: ~starts_import(t) & ~tx.is_blank(t) & ~t.startswith("#")), True
        ).cast("int")
        block = F.slice(lines, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(lines)))
        at = F.coalesce(
            F.array_max(F.transform(block, lambda t, i: F.when(starts_import(t), i + 1).otherwise(0))), F.lit(0)
        )
        return let(
            at,
            lambda a: F.array_join(
                F.concat(
                    F.slice(lines, F.lit(1), a), F.array(F.lit("import os")), F.slice(lines, a + 1, F.size(lines))
                ),
                "\n",
            ),
        )

    return F.when(
        code.contains("os.environ") & ~code.contains("import os"), let(tx.split_lines(code), insert)
    ).otherwise(code)


#: The places where a word begins or ends: a text parted there has whole words and what lies between them.
_EDGE = "(?U)" + f"(?<={tx.WORD})(?!{tx.WORD})|(?<!{tx.WORD})(?={tx.WORD})"


def _renamed(text: Column, word) -> Column:
    """A text with each of its words (and what lies between them) replaced by ``word`` of it."""
    return F.array_join(F.transform(F.split(text, _EDGE, -1), word), "")


def _mapped(text: Column, names: Column) -> Column:
    """All renames so far at once: ``names`` has the present word for each word of the original text that changed."""
    return F.when(F.size(names) == 0, text).otherwise(_renamed(text, lambda t: F.coalesce(names[t], t)))


def _renamed_since(text: Column, renames: Column, since: Column) -> Column:
    """The renames behind the first ``since`` ones, in order, on a line that was written then."""
    later = F.slice(renames, since + 1, F.size(renames))
    follow = lambda w, r: F.when(w == r["old"], r["new"]).otherwise(w)
    return F.when(F.size(renames) == since, text).otherwise(_renamed(text, lambda t: F.aggregate(later, t, follow)))


def _with_rename(names: Column, old: Column, new: Column) -> Column:
    """The map after one more rename: words that had become ``old`` become ``new``, and so does ``old`` itself if it still stood."""
    moved = F.transform_values(names, lambda _, now: F.when(now == old, new).otherwise(now))
    none = F.create_map().cast("map<string,string>")
    return F.map_concat(moved, F.when(F.map_contains_key(names, old), none).otherwise(F.create_map(old, new)))


_STATE = {
    "names": "map<string,string>", "renames": "array<struct<old:string,new:string>>",
    "placed": "array<struct<line:int,text:string,since:int>>", "fixed": "array<string>", "changes": "array<string>",
}


def fold_fixes(content: Column, fixes: Column) -> Column:
    """struct<code, fixed, changes> after all fixes. ``fixes``: array<struct<line, rule_id, suggestion, ...>> in the order of
    application, by line descending; each fix sees the text the previous one left.

    The text itself is written once, at the end: renames are composed into one map of words, and a replaced line is held with
    the number of renames made before it, so that only later ones reach it.
    """
    start = F.struct(
        F.create_map().cast(_STATE["names"]).alias("names"), *[F.array().cast(t).alias(k) for k, t in _STATE.items() if k != "names"]
    )

    def fold(lines):
        def step(acc, v):
            n = F.size(acc["renames"])
            last = F.try_element_at(acc["placed"], F.lit(-1))
            again = F.coalesce(last["line"] == v["line"], F.lit(False))
            base = F.when(v["line"] >= 1, F.get(lines, v["line"] - 1))
            now = F.when(again, _renamed_since(last["text"], acc["renames"], last["since"])).otherwise(_mapped(base, acc["names"]))

            def done(change, **new):
                held = {
                    **{k: acc[k] for k in ("names", "renames", "placed")}, **new,
                    "fixed": F.concat(acc["fixed"], F.array(v["rule_id"])), "changes": F.concat(acc["changes"], F.array(change)),
                }
                return F.struct(*[held[k].cast(t).alias(k) for k, t in _STATE.items()])

            def placed(text):
                # Fixes go upwards, so a line that is replaced again is the last one that was.
                before = F.when(again, F.slice(acc["placed"], F.lit(1), F.size(acc["placed"]) - 1)).otherwise(acc["placed"])
                entry = F.struct(v["line"].cast("int").alias("line"), text.alias("text"), n.alias("since"))
                return F.concat(before, F.array(entry)).cast(_STATE["placed"])

            def renamed(names):
                old, new = names["old"], names["new"]
                return F.when(
                    (old != "") & (new != ""),
                    done(
                        F.concat(F.lit("Renamed '"), old, F.lit("' to '"), new, F.lit("'")),
                        names=_with_rename(acc["names"], old, new),
                        renames=F.concat(acc["renames"], F.array(F.struct(old.alias("old"), new.alias("new")))),
                    ),
                )

            def on_line(line):
                rename_of = F.struct(defined_name(line).alias("old"), new_name_of(v["suggestion"]).alias("new"))
                clause = lambda new: F.when(
                    new.isNotNull(), done(F.lit("Changed bare 'except:' to 'except Exception as e:'"), placed=placed(new))
                )
                secret = lambda new: F.when(new.isNotNull(), done(new["change"], placed=placed(new["line"])))
                return (
                    F.when(line.isNull(), acc)
                    .when(v["rule_id"] == "S002", F.coalesce(let(rename_of, renamed), acc))
                    .when(v["rule_id"] == "BP001", F.coalesce(let(bare_except_fix(line), clause), acc))
                    .when(v["rule_id"] == "SEC001", F.coalesce(let(secret_fix(line), secret), acc))
                    .otherwise(acc)
                )

            return let(now, on_line)

        def written(acc):
            at = F.reverse(acc["placed"])

            def gap(above, below):
                """The lines between two replaced ones as one text."""
                some = F.slice(lines, above + 1, below - above - 1)
                return F.when(
                    below - above > 1, F.array(_mapped(F.array_join(some, "\n"), acc["names"]))
                ).otherwise(F.array().cast("array<string>"))

            parts = F.flatten(
                F.transform(
                    at,
                    lambda p, i: F.concat(
                        gap(F.coalesce(F.get(at, i - 1)["line"], F.lit(0)), p["line"]),
                        F.array(_renamed_since(p["text"], acc["renames"], p["since"])),
                    ),
                )
            )
            rest = gap(F.coalesce(F.try_element_at(at, F.lit(-1))["line"], F.lit(0)), F.size(lines) + 1)
            return F.struct(F.array_join(F.concat(parts, rest), "\n").alias("code"), acc["fixed"].alias("fixed"), acc["changes"].alias("changes"))

        return F.aggregate(fixes, start, step, written)

    return let(tx.split_lines(content), fold)


def fix_lists(violations: DataFrame, min_violations: int = 2) -> DataFrame:
    """One row per file with enough violations: the fixable ones, by line descending, ties in report order.

    Only the fields a fix needs are collected; a list is bounded by the lines of its own file.
    """
    item = F.when(
        F.col("rule_id").isin(*FIXABLE_RULES),
        F.struct((-F.col("line")).alias("by"), "rule_ord", "seq", "line", "rule_id", "suggestion"),
    )
    return (
        violations.groupBy(*PR_KEY, F.col("file").alias("filename"))
        .agg(F.count(F.lit(1)).alias("n_violations"), F.sort_array(F.collect_list(item)).alias("fixes"))
        .filter(F.col("n_violations") >= min_violations)
    )


def fix_order(violations: DataFrame) -> DataFrame:
    """The order in which fixes are applied, one row per fix."""
    return fix_lists(violations).select(*PR_KEY, "filename", F.posexplode("fixes").alias("pos", "fix")).select(
        *PR_KEY, "filename", "pos", "fix.line", "fix.rule_id"
    )


def apply_fixes(files: DataFrame, violations: DataFrame) -> DataFrame:
    """Result per file with at least two violations: rewritten text, what was fixed, and the failure shapes.

    ``files`` must hold ``repo, pr_number, file_ord, filename, content`` (null content: could not be read).
    """
    joined = files.select(*PR_KEY, "file_ord", "filename", "content").join(
        fix_lists(violations), [*PR_KEY, "filename"]
    )
    keep = [*PR_KEY, "file_ord", "filename", "content"]
    folded = compute_once(
        joined, keep, {"fold": F.when(F.col("content").isNotNull(), fold_fixes(F.col("content"), F.col("fixes")))}
    )
    raw = folded.select(
        *keep, "fold.fixed", "fold.changes", F.col("fold.code").alias("raw_code"),
    )
    changed = F.coalesce(F.col("content").isNotNull() & (F.col("raw_code") != F.col("content")), F.lit(False))
    ready = compute_once(
        raw,
        [*keep, "fixed", "changes", "raw_code"],
        {"changed": changed, "refactored": F.when(changed, ensure_import(F.col("raw_code")))},
    )
    missing = F.col("content").isNull()
    ok = F.col("changed")
    with_import = F.col("refactored") != F.col("raw_code")
    changes = F.when(with_import, F.concat("changes", F.array(F.lit("Added: import os")))).otherwise(F.col("changes"))
    return ready.select(
        *PR_KEY,
        "file_ord",
        "filename",
        F.coalesce("content", F.lit("")).alias("original_code"),
        F.when(missing, "").when(ok, F.col("refactored")).otherwise(F.col("content")).alias("refactored_code"),
        F.when(missing, "Failed to fetch file")
        .when(ok, F.array_join(changes, "\n"))
        .otherwise("No automatic fixes available")
        .alias("changes_description"),
        F.when(ok, F.col("fixed")).otherwise(F.array().cast("array<string>")).alias("violations_fixed"),
        ok.alias("success"),
        F.when(missing, "Could not fetch file contents").alias("error_message"),
    )


def with_model_rewrites(results: DataFrame, violations: DataFrame, answers: DataFrame) -> DataFrame:
    """Results where a model's rewrite stands in for a file without any automatic fix; all its rule ids count as fixed.

    ``answers``: ``repo, pr_number, filename, response``, one a file. An answer without a text, or with the original one, changes nothing.
    """
    key = [*PR_KEY, "filename"]
    free = results.filter(~F.col("success") & F.col("error_message").isNull()).select(*key)
    told = answers.join(free, key, "left_semi").select(*key, "response")
    told = compute_once(told, key, {"answer": parse_refactoring(F.col("response"))}).filter("answer is not null")
    item = F.struct("rule_ord", "line", "seq", "rule_id")
    ids = (
        violations.withColumnRenamed("file", "filename")
        .join(told.select(*key), key, "left_semi")
        .groupBy(*key)
        .agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["rule_id"]).alias("ids"))  # of one file
    )
    j = results.join(told.join(ids, key), key, "left")
    code = ensure_import(F.col("answer.refactored_code"))
    plain = F.col("answer.refactored_code")
    use = F.coalesce(~F.col("success") & F.col("error_message").isNull() & (plain != F.col("original_code")), F.lit(False))
    note = F.coalesce(F.col("answer.explanation"), F.lit("LLM refactoring applied"))
    note = F.when(code != plain, F.concat(note, F.lit("\nAdded: import os"))).otherwise(note)
    new = {
        "refactored_code": F.when(use, code).otherwise(F.col("refactored_code")),
        "changes_description": F.when(use, note).otherwise(F.col("changes_description")),
        "violations_fixed": F.when(use, F.col("ids")).otherwise(F.col("violations_fixed")),
        "success": F.col("success") | use,
    }
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in results.columns))


def commit_message(violations_fixed: Column) -> Column:
    return F.concat(F.lit("Auto-fix: "), F.array_join(F.slice(violations_fixed, 1, 3), ", "))

