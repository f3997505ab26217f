"""Python regular expressions as Java ones.

A rule file holds Python patterns; the engine runs Java ones, where the same text can mean something else: a bracket or ``&&`` inside a
class, ``\\Z``, a named reference, what a line end or a word is. The pattern is therefore read by Python's own parser and written
anew from its parts, with every class spelled out, so that no flag of the other side changes it. What has no counterpart is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

_parser = re._parser
_c = re._constants
MAXREPEAT = _c.MAXREPEAT

# The classes of Python's str patterns, as the inside of a Java class.
DIGIT, DIGIT_ASCII = r"\p{Nd}", "0-9"
WORD, WORD_ASCII = r"\p{L}\p{N}_", "a-zA-Z0-9_"
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_ASCII = r"\x09-\x0D\x20"
ANY = r"[\x{0}-\x{10FFFF}]"


class Untranslatable(ValueError):
    """The pattern has a part without a Java counterpart."""


@dataclass(frozen=True)
class Translation:
    """``java``: the pattern; ``groups``: the Java number of each Python group."""

    java: str
    groups: dict[int, int] = field(default_factory=dict)


def _char(code: int) -> str:
    if 0xD800 <= code <= 0xDFFF:
        raise Untranslatable("a lone surrogate")
    c = chr(code)
    return c if c.isascii() and (c.isalnum() or c in "_ ") else f"\\x{{{code:X}}}"


class _Writer:
    def __init__(self, conditions: set[int]) -> None:
        self.conditions = conditions
        self.groups: dict[int, int] = {}
        self.marks: dict[int, int] = {}
        self.next = 1

    def all(self, parts, flags: int) -> str:
        return "".join(self.one(op, arg, flags) for op, arg in parts)

    def one(self, op, arg, flags: int) -> str:
        write = getattr(self, "_" + str(op).lower(), None)
        if write is None:
            raise Untranslatable(str(op).lower())
        return write(arg, flags)

    # ------------------------------------------------------------------------------------------ characters

    def _literal(self, code, flags):
        return _char(code)

    def _not_literal(self, code, flags):
        return f"[^{_char(code)}]"

    def _any(self, _, flags):
        return ANY if flags & re.DOTALL else r"[^\x0A]"

    def _class(self, category, flags) -> tuple[str, bool]:
        """The inside of a class, and whether it is meant negated."""
        name = str(category).lower().removeprefix("category_")
        negated = name.startswith("not_")
        ascii_only = bool(flags & re.ASCII)
        inside = {
            "digit": (DIGIT, DIGIT_ASCII), "word": (WORD, WORD_ASCII), "space": (SPACE, SPACE_ASCII),
        }[name.removeprefix("not_")][ascii_only]
        return inside, negated

    def _in(self, items, flags):
        negated = items[0][0] is _c.NEGATE
        inside, others = "", []
        for op, arg in items[negated:]:
            if op is _c.LITERAL:
                inside += _char(arg)
            elif op is _c.RANGE:
                inside += f"{_char(arg[0])}-{_char(arg[1])}"
            else:
                names, without = self._class(arg, flags)
                if without:
                    others.append(f"[^{names}]")
                else:
                    inside += names
        if not others:
            return f"[{'^' if negated else ''}{inside}]"
        either = "|".join(([f"[{inside}]"] if inside else []) + others)
        return f"(?:(?!{either}){ANY})" if negated else f"(?:{either})"

    # --------------------------------------------------------------------------------------------- places

    def _at(self, where, flags):
        word = f"[{WORD_ASCII if flags & re.ASCII else WORD}]"
        many = bool(flags & re.MULTILINE)
        return {
            _c.AT_BEGINNING: r"(?<![^\x0A])" if many else r"\A",
            _c.AT_BEGINNING_STRING: r"\A",
            _c.AT_END: r"(?![^\x0A])" if many else r"(?=\x0A?\z)",
            _c.AT_END_STRING: r"\z",
            _c.AT_BOUNDARY: f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
            # Before version 3.14 there is no place that is none in an empty text.
            _c.AT_NON_BOUNDARY: f"(?:(?<={word})(?={word})|(?<!{word})(?!{word})(?!\\A\\z))",
        }[where]

    # ---------------------------------------------------------------------------------------------- shapes

    def _branch(self, arg, flags):
        return "(?:" + "|".join(self.all(p, flags) for p in arg[1]) + ")"

    def _subpattern(self, arg, flags):
        number, add, remove, parts = arg
        inner = (flags | add) & ~remove
        if number is not None:
            self.groups[number] = self.next
            self.next += 1
            if number in self.conditions:
                self.marks[number] = self.next
                self.next += 1
        body = self.all(parts, inner)
        if (flags ^ inner) & re.IGNORECASE:
            body = f"(?{'iu' if inner & re.IGNORECASE else '-iu'}:{body})"
        if number is None:
            return f"(?:{body})"
        # An empty group behind the part matches, and does so always, once the group has matched.
        return f"({body}())" if number in self.conditions else f"({body})"

    def _repeat(self, arg, flags, kind: str) -> str:
        low, high, parts = arg
        body = self.all(parts, flags)
        if len(parts) != 1 or parts[0][0] not in (_c.LITERAL, _c.NOT_LITERAL, _c.ANY, _c.IN):
            body = f"(?:{body})"
        if high is MAXREPEAT:
            times = "*" if low == 0 else "+" if low == 1 else f"{{{low},}}"
        else:
            times = "?" if (low, high) == (0, 1) else f"{{{low},{high}}}"
        return body + times + kind

    def _max_repeat(self, arg, flags):
        return self._repeat(arg, flags, "")

    def _min_repeat(self, arg, flags):
        return self._repeat(arg, flags, "?")

    def _possessive_repeat(self, arg, flags):
        return self._repeat(arg, flags, "+")

    def _atomic_group(self, parts, flags):
        return f"(?>{self.all(parts, flags)})"

    def _assert(self, arg, flags, sign: str = "="):
        direction, parts = arg
        if direction < 0 and _refers(parts):
            raise Untranslatable("a reference inside a look-behind")
        return f"(?{'<' if direction < 0 else ''}{sign}{self.all(parts, flags)})"

    def _assert_not(self, arg, flags):
        return self._assert(arg, flags, "!")

    def _failure(self, _, flags):
        return "(?!)"

    def _groupref(self, number, flags):
        return f"(?:\\{self.groups[number]})"

    def _groupref_exists(self, arg, flags):
        number, yes, no = arg
        mark = f"\\{self.marks[number]}"
        return f"(?:(?:{mark}){self.all(yes, flags)}|(?!{mark}){self.all(no, flags) if no is not None else ''})"


def _walk(parts):
    for op, arg in parts:
        yield op, arg
        stack = [arg]
        while stack:
            x = stack.pop()
            if isinstance(x, _parser.SubPattern):
                yield from _walk(x)
            elif isinstance(x, (tuple, list)):
                stack += x


def _refers(parts) -> bool:
    return any(op in (_c.GROUPREF, _c.GROUPREF_EXISTS) for op, _ in _walk(parts))


@lru_cache(maxsize=4096)
def translate(pattern: str, ignore_case: bool = False) -> Translation:
    """The Java form of a Python ``str`` pattern. Raises ``re.error`` for no pattern, ``Untranslatable`` for one without that form."""
    tree = _parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
    flags = tree.state.flags
    if flags & re.LOCALE:
        raise Untranslatable("a locale")
    if flags & re.DEBUG:
        raise Untranslatable("the debug flag")
    conditions = {arg[0] for op, arg in _walk(tree) if op is _c.GROUPREF_EXISTS}
    writer = _Writer(conditions)
    body = writer.all(tree, flags)
    case = ("(?i)" if flags & re.ASCII else "(?iu)") if flags & re.IGNORECASE else ""
    return Translation(case + body, writer.groups)
