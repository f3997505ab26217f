"""The per-file helper behind the syntax-tree facts. Runs inside tasks on Arrow batches."""

from __future__ import annotations

import ast
import gc
import re
import warnings
from contextlib import contextmanager
from heapq import heappop, heappush
from operator import attrgetter

import pyarrow as pa

# Node kinds that add one to the complexity. Boolean operators count once per operator.
_COMPLEX = (
    ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Assert, ast.IfExp, ast.ListComp,
    ast.DictComp, ast.SetComp, ast.GeneratorExp, ast.Match, ast.match_case,
)
_COUNTED = frozenset(_COMPLEX)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


# Where the parser counts a new line: other characters that splitlines() breaks at are ordinary ones to it.
_LINE_END = re.compile(r"(?<=\n)|(?<=\r)(?!\n)")


class _Source:
    """Cuts node text out of the source; columns in the tree are UTF-8 byte offsets."""

    def __init__(self, code: str):
        if "\r" in code:
            self.lines, self.end = [line.encode() for line in _LINE_END.split(code)], b""
        else:
            self.lines, self.end = code.encode().split(b"\n"), b"\n"

    def text(self, node) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.lines[a][node.col_offset:node.end_col_offset].decode(errors="replace")
        middle = self.lines[a + 1:b]
        first, last = self.lines[a][node.col_offset:], self.lines[b][:node.end_col_offset]
        return self.end.join([first, *middle, last]).decode(errors="replace")


def _docstring(body, src):
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant):
        if isinstance(body[0].value.value, str):
            return src.text(body[0].value)
    return None


def _parameters(args: ast.arguments) -> list[str]:
    names = [a.arg for a in (*args.posonlyargs, *args.args)]
    if args.vararg:
        names.append("*" + args.vararg.arg)
    names += [a.arg for a in args.kwonlyargs]
    if args.kwarg:
        names.append("**" + args.kwarg.arg)
    return names


def _function(node, src, class_name, class_line, complexity: int, calls: list[str]) -> dict:
    first = node.body[0]
    start = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", ()))])
    return {
        "name": node.name, "class_name": class_name, "class_line": class_line, "start_line": node.lineno, "end_line": node.end_lineno,
        "body_start_line": start, "parameters": _parameters(node.args),
        "return_type": src.text(node.returns) if node.returns else None,
        "decorators": ["@" + src.text(d) for d in node.decorator_list],
        "is_async": isinstance(node, ast.AsyncFunctionDef), "docstring": _docstring(node.body, src),
        "complexity": complexity, "calls": sorted(set(calls)),
    }


def _facts(tree: ast.Module, src: _Source) -> dict:
    """All facts from one walk. A function's complexity and calls are what the walk adds while it is in the body, so nested
    functions are not walked again. Entries are listed where the walk meets them; methods where it meets their class."""
    functions, methods, classes, imports, variables, calls = [], [], [], [], [], []
    inside, fields, counted, scopes = _VALUES, _INSIDE, _COUNTED, _SCOPES

    def scope(node, in_class: bool, in_function: bool, owner) -> int:
        """A class or function. ``owner``: class and place of a method."""
        is_class = node.__class__ is ast.ClassDef
        place, listed = None, functions
        if is_class:
            classes.append({
                "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno,
                "bases": [b.id for b in node.bases if isinstance(b, ast.Name)],
                "decorators": ["@" + src.text(d) for d in node.decorator_list],
                "docstring": _docstring(node.body, src), "methods": [m.name for m in node.body if isinstance(m, _DEFS)],
            })
            place = len(methods)
            methods.extend(None for m in node.body if isinstance(m, _DEFS))
        elif owner:
            place, listed = owner[1], methods
        elif not in_class:
            place = len(functions)
            functions.append(None)
        below = in_body = body_from = body_to = 0
        in_class, in_function = in_class or is_class, in_function or not is_class
        for field in fields[node.__class__]:
            value = getattr(node, field)
            if value.__class__ is list:
                own = field == "body"
                if own:
                    body_from = len(calls)
                for child in value:
                    if child.__class__ in scopes:
                        mine = None
                        if own and is_class and child.__class__ is not ast.ClassDef:
                            mine, place = (node, place), place + 1
                        w = scope(child, in_class, in_function, mine)
                    elif child.__class__ in inside:
                        w = walk(child, in_class, in_function, False)
                    else:
                        continue
                    below += w
                    if own:
                        in_body += w
                if own:
                    body_to = len(calls)
            elif value.__class__ in inside:
                below += walk(value, in_class, in_function, False)
        if not is_class and place is not None:
            of = (owner[0].name, owner[0].lineno) if owner else (None, None)
            listed[place] = _function(node, src, *of, 1 + in_body, calls[body_from:body_to])
        return below

    def walk(node, in_class: bool, in_function: bool, starred: bool) -> int:
        """What the node and all below it add to the complexity of a function around it."""
        kind = node.__class__
        if kind is ast.Call:
            if node.func.__class__ is ast.Name or node.func.__class__ is ast.Attribute:
                calls.append(src.text(node.func))
        elif kind is ast.Import:
            imports.extend(
                {"module": a.name, "names": [], "alias": a.asname, "line": node.lineno, "is_from_import": False}
                for a in node.names
            )
        elif kind is ast.ImportFrom:
            imports.append({
                "module": "." * node.level + (node.module or ""), "names": [a.name for a in node.names],
                "alias": None, "line": node.lineno, "is_from_import": True,
            })
        elif not in_class and not in_function and (kind is ast.Assign or kind is ast.AnnAssign):
            name = src.text(node.targets[0] if kind is ast.Assign else node.target)
            if not name.startswith("_"):
                variables.append({"name": name, "line": node.lineno})
        below, star = 0, kind is ast.TryStar
        for value in inside[kind](node):
            if value.__class__ is list:
                for child in value:
                    if child.__class__ in scopes:
                        below += scope(child, in_class, in_function, None)
                    elif child.__class__ in inside:
                        below += walk(child, in_class, in_function, star)
            elif value.__class__ in inside:
                below += walk(value, in_class, in_function, star)
        if kind in counted:
            below += 1
        elif kind is ast.ExceptHandler:
            below += not starred
        elif kind is ast.BoolOp:
            below += len(node.values) - 1
        return below

    walk(tree, False, False, False)
    return {"functions": functions + methods, "classes": classes, "imports": imports, "globals": variables}


def facts_or_none(code: str | None) -> dict | None:
    """Facts of a text, or None when it is missing or does not parse."""
    if code is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _facts(ast.parse(code), _Source(code))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _refused(e: SyntaxError) -> dict:
    return {"ok": False, "line": e.lineno, "offset": e.offset, "message": e.msg, "text": e.text}


def syntax_of(code: str | None) -> dict | None:
    if code is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(code, "<file>", "exec", dont_inherit=True)
        return {"ok": True, "line": None, "offset": None, "message": None, "text": None}
    except SyntaxError as e:
        return _refused(e)
    except (ValueError, RecursionError, MemoryError) as e:
        return {"ok": False, "line": None, "offset": None, "message": str(e), "text": None}


# Nodes that are no complexity and hold none; they are most of a tree.
_LEAVES = (
    ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias, ast.arg,
    ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop, ast.type_ignore,
)
# Fields that hold texts and numbers, or only leaves.
_PLAIN_FIELDS = {"ctx", "op", "ops", "id", "attr", "name", "names", "module", "level", "kind", "type_comment", "rest", "is_async", "simple", "conversion", "type_ignores"}


def _node_types(base: type) -> list[type]:
    return [base, *(t for sub in base.__subclasses__() for t in _node_types(sub))]


def _node_fields(t: type) -> tuple[str, ...]:
    return tuple(f for f in t._fields if f not in _PLAIN_FIELDS)


#: The fields to look into, by type of node; leaves are not in it. An argument is no leaf: its annotation may hold anything.
_INSIDE = {t: _node_fields(t) for t in _node_types(ast.AST) if not issubclass(t, _LEAVES) or t is ast.arg}


#: What to look into of a node, in one call. A class stands in where there is less than two fields, as a getter of one gives no tuple.
_VALUES = {t: attrgetter(*fields, *["__class__"] * (2 - len(fields))) for t, fields in _INSIDE.items()}
_SCOPES = frozenset({ast.ClassDef, *_DEFS})


class _Outline:
    """Names and the complexity of all functions and methods of the statements it is given: what ``_facts`` says of them."""

    __slots__ = ("functions", "classes", "imports", "score")

    def __init__(self):
        self.functions, self.classes, self.imports, self.score = set(), set(), set(), 0

    def add(self, other: _Outline) -> None:
        self.functions |= other.functions
        self.classes |= other.classes
        self.imports |= other.imports
        self.score += other.score

    def row(self) -> dict:
        return {
            "functions": sorted(self.functions), "classes": sorted(self.classes), "imports": sorted(self.imports),
            "score": self.score,
        }

    def walk(self, node, in_class: bool, method: bool, starred: bool) -> int:
        """From the leaves up: what the node and all below it add to the complexity of a function around it."""
        kind = node.__class__
        inside, walk, below = _VALUES, self.walk, 0
        if kind in _SCOPES:
            is_class, in_body = kind is ast.ClassDef, 0
            deeper = in_class or is_class
            for field in _INSIDE[kind]:
                value, own = getattr(node, field), field == "body"
                if value.__class__ is list:
                    w = 0
                    for child in value:
                        if child.__class__ in inside:
                            w += walk(child, deeper, own and is_class, False)
                    below += w
                    if own:
                        in_body = w
                elif value.__class__ in inside:
                    below += walk(value, deeper, False, False)
            if is_class:
                self.classes.add(node.name)
            else:
                if not in_class:
                    self.functions.add(node.name)
                if method or not in_class:
                    self.score += 1 + in_body
            return below
        star = kind is ast.TryStar
        for value in inside[kind](node):
            if value.__class__ is list:
                for child in value:
                    if child.__class__ in inside:
                        below += walk(child, in_class, False, star)
            elif value.__class__ in inside:
                below += walk(value, in_class, False, star)
        if kind in _COUNTED:
            return below + 1
        if kind is ast.BoolOp:
            return below + len(node.values) - 1
        if kind is ast.ExceptHandler:
            return below + (not starred)
        if kind is ast.Import:
            self.imports.update(a.name for a in node.names)
        elif kind is ast.ImportFrom:
            self.imports.add("." * node.level + (node.module or ""))
        return below


def _outline(tree: ast.Module) -> _Outline:
    out = _Outline()
    out.walk(tree, False, False, False)
    return out


# In front of a line that may begin a statement of the module, and none that goes on with the one before.
_CUT = re.compile(r"(?<=\n)(?=[A-Za-z_@])(?!(?:elif|else|except|finally)\b)")


def _chunks(code: str) -> list[str] | None:
    """The text in pieces that begin where a statement of the module may begin, decorators with what they decorate. None where lines
    or words are not what they seem: other line ends, another grammar."""
    if "\r" in code or "barry_as_FLUFL" in code:
        return None
    out, open_ = [], False
    for piece in _CUT.split(code):
        if open_:
            out[-1] += piece
        else:
            out.append(piece)
        open_ = piece.startswith("@")
    return out


def _begin(statement: ast.stmt) -> int:
    return min([statement.lineno, *(d.lineno for d in getattr(statement, "decorator_list", ()))])


#: A chunk that was parsed: its outline and its statements.
_Part = tuple[_Outline, list[ast.stmt]]


def _outlines_of_chunks(code: str, tree: ast.Module) -> tuple[_Outline, dict[str, _Part]]:
    """The outline of a text, and the parts of its chunks; none of these unless every chunk begins with a statement of its own."""
    chunks = _chunks(code)
    # A statement further to the right may stand behind the end of a text of many lines.
    begins = {_begin(s) for s in tree.body if not s.col_offset}
    starts, line = [], 1
    for c in chunks or ():
        starts.append(line)
        line += c.count("\n")
    if not chunks or not begins.issuperset(starts[1:]):
        return _outline(tree), {}
    whole, parts, at, n = _Outline(), [(_Outline(), []) for _ in chunks], 0, len(chunks)
    for s in tree.body:
        begin = _begin(s)
        while at + 1 < n and starts[at + 1] <= begin:
            at += 1
        outline, body = parts[at]
        if s.__class__ in _INSIDE:
            outline.walk(s, False, False, False)
        body.append(s)
    for outline, _ in parts:
        whole.add(outline)
    return whole, dict(zip(chunks, parts, strict=True))


def _outline_beside(code: str, known: dict[str, _Part]) -> tuple[_Outline, ast.Module | None] | None:
    """The outline of a text much of which is known from another version of it, and its tree put together of the parts: only the
    other chunks are parsed. A text whose chunks all parse, each alone, parses as their sequence. None where that does not hold or
    little is known; no tree where the place of a statement counts, as lines are those of the parts."""
    chunks = _chunks(code) if known else None
    if not chunks:
        return None
    if sum(len(c) for c in chunks if c not in known) * 2 > len(code):
        return None
    out, body = _Outline(), []
    for c in chunks:
        part = known.get(c)
        if part is None:
            tree = tree_or_none(c)
            if tree is None:
                return None
            part = _outline(tree), tree.body
        out.add(part[0])
        body += part[1]
    return out, None if "__future__" in code else ast.Module(body, [])


def _parsed(code: str | None) -> tuple[ast.Module | None, dict | None]:
    """The tree of a text, or what the parser says against it: that is what compiling the text says, which begins with the same parser."""
    if code is None:
        return None, None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code), None
    except SyntaxError as e:
        return None, _refused(e)
    except (ValueError, RecursionError, MemoryError):
        return None, None


def tree_or_none(code: str | None) -> ast.Module | None:
    return _parsed(code)[0]


def outline_or_none(code: str | None) -> dict | None:
    return outline_of(tree_or_none(code))


def outline_of(tree: ast.Module | None) -> dict | None:
    try:
        return None if tree is None else _outline(tree).row()
    except (RecursionError, MemoryError):
        return None


def _versions(a: str | None, b: str | None) -> tuple[dict | None, dict | None, ast.Module | None, ast.Module | None, dict | None]:
    """The outlines of both versions of a file; of the second the tree if it was made whole, else the tree put together of parts,
    else what the parser says against it. What the second has from the first is not parsed again."""
    tree, refused = _parsed(a)
    if a == b:
        outline = outline_of(tree)
        return outline, outline, tree, None, refused
    before, known = None, {}
    try:
        if tree is not None:
            whole, known = _outlines_of_chunks(a, tree)
            before = whole.row()
        if b is not None and (beside := _outline_beside(b, known)) is not None:
            return before, beside[0].row(), None, beside[1], None
    except (RecursionError, MemoryError):
        pass
    tree, refused = _parsed(b)
    return before, outline_of(tree), tree, None, refused


def pair_outlines(a: str | None, b: str | None) -> tuple[dict | None, dict | None, ast.Module | None]:
    """The outlines of both versions of a file, and the tree of the second if it was made whole."""
    return _versions(a, b)[:3]


def syntax_of_tree(tree: ast.Module | None, code: str | None) -> dict | None:
    """The syntax of a text whose tree is at hand: only the rest of the compilation is done. What fails there is compiled
    from the text, which alone knows the place of the error."""
    if tree is not None:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(tree, "<file>", "exec", dont_inherit=True)
            return {"ok": True, "line": None, "offset": None, "message": None, "text": None}
        except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
            pass
    return syntax_of(code)


@contextmanager
def _no_collection():
    """Trees are many small objects in use: looking for garbage among them again and again costs more than parsing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_strings = pa.list_(pa.string())
_FACTS = pa.struct([
    ("functions", pa.list_(pa.struct([
        ("name", pa.string()), ("class_name", pa.string()), ("class_line", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()),
        ("body_start_line", pa.int32()), ("parameters", _strings), ("return_type", pa.string()),
        ("decorators", _strings), ("is_async", pa.bool_()), ("docstring", pa.string()),
        ("complexity", pa.int32()), ("calls", _strings)]))),
    ("classes", pa.list_(pa.struct([
        ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("bases", _strings),
        ("decorators", _strings), ("docstring", pa.string()), ("methods", _strings)]))),
    ("imports", pa.list_(pa.struct([
        ("module", pa.string()), ("names", _strings), ("alias", pa.string()), ("line", pa.int32()),
        ("is_from_import", pa.bool_())]))),
    ("globals", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32())]))),
])
_SYNTAX = pa.struct([
    ("ok", pa.bool_()), ("line", pa.int32()), ("offset", pa.int32()), ("message", pa.string()), ("text", pa.string()),
])


#: Texts whose results are Python objects at one time; the rest of a batch is Arrow memory.
_AT_ONCE = 32


def _in_parts(each, columns: tuple[pa.Array, ...], kind: pa.DataType) -> pa.Array:
    """``each`` of all rows, some rows at a time: a batch of thousands of files is never held as Python objects."""
    parts = []
    for i in range(0, len(columns[0]), _AT_ONCE):
        rows = zip(*(c.slice(i, _AT_ONCE).to_pylist() for c in columns), strict=True)
        with _no_collection():
            parts.append(pa.array([each(*r) for r in rows], type=kind))
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)


def facts_batch(content: pa.Array) -> pa.Array:
    return _in_parts(facts_or_none, (content,), _FACTS)


_OUTLINE = pa.struct([("functions", _strings), ("classes", _strings), ("imports", _strings), ("score", pa.int32())])
_PAIR = pa.struct([("syntax", _SYNTAX), ("before", _OUTLINE), ("after", _OUTLINE)])


def pair_batch(original: pa.Array, refactored: pa.Array, is_python: pa.Array) -> pa.Array:
    """Syntax of the second text, and the outlines of both where the file is a Python one."""

    def both(a: str | None, b: str | None, python: bool | None) -> dict:
        # A text that does not compile may still parse; its tree is read before it is compiled.
        before, after, tree, pieces, refused = _versions(a, b) if python else (None,) * 5
        return {"syntax": refused or syntax_of_tree(tree or pieces, b), "before": before, "after": after}

    return _in_parts(both, (original, refactored, is_python), _PAIR)


_OUTLINES = pa.struct([("before", _OUTLINE), ("after", _OUTLINE)])


def outlines_batch(original: pa.Array, refactored: pa.Array, is_python: pa.Array) -> pa.Array:
    """The outlines of ``pair_batch`` alone: nothing is compiled."""

    def both(a: str | None, b: str | None, python: bool | None) -> dict:
        before, after, _ = pair_outlines(a, b) if python else (None, None, None)
        return {"before": before, "after": after}

    return _in_parts(both, (original, refactored, is_python), _OUTLINES)


_SEGMENTS = pa.struct([("starts", pa.list_(pa.int32())), ("names", _strings)])


def _segments(names: list | None, first: list | None, last: list | None) -> dict | None:
    """The lines at which the covering span changes, in order, and the name of the first span of the list that covers from there on."""
    if names is None:
        return None
    starts = sorted({*first, *(b + 1 for b in last)})
    opening = {}
    for i, a in enumerate(first):
        opening.setdefault(a, []).append(i)
    covering, found = [], []
    for line in starts:
        for i in opening.get(line, ()):
            heappush(covering, i)
        while covering and last[covering[0]] < line:
            heappop(covering)
        found.append(names[covering[0]] if covering else None)
    return {"starts": starts, "names": found}


def segments_batch(names: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    return _in_parts(_segments, (names, first, last), _SEGMENTS)
