"""Filter text to columns.

Grammar, loosest first: OR, AND, NOT, then parentheses or a test.  A test compares a column with a
literal (``== = != <> < <= > >=``), or is ``IN (...)``/``IN [...]``, ``LIKE``, ``BETWEEN a AND b``,
``IS [NOT] NULL``, or a bare name, which asks that the attribute is there.  A null never matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<op>==|!=|<>|<=|>=|=|<|>)|(?P<punc>[()\[\],])|(?P<quoted>`[^`]+`)|(?P<name>[A-Za-z_][\w.]*))""")
_TESTS = {"==": "__eq__", "=": "__eq__", "!=": "__ne__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


class PredicateError(ValueError):
    """Text that the grammar doesn't cover, or a column that isn't there."""


class _Parser:
    def __init__(self, text: str, columns: set[str] | None):
        self.columns, self.at, self.items = columns, 0, []
        pos = 0
        while text[pos:].strip():
            m = _TOKEN.match(text, pos)
            if not m:
                raise PredicateError(f"can't read {text[pos:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self, *words: str) -> bool:
        if self.at >= len(self.items):
            return False
        kind, v = self.items[self.at]
        return v in words if kind in ("op", "punc") else kind == "name" and v.upper() in words

    def take(self, *words: str) -> bool:
        found = self.peek(*words)
        self.at += found
        return found

    def need(self, word: str) -> None:
        if not self.take(word):
            raise PredicateError(f"expected {word} at item {self.at}")

    def either(self) -> Column:
        out = self.both()
        while self.take("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negated()
        while self.take("AND"):
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        if self.take("NOT"):
            return ~self.negated()
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        return self.test()

    def literal(self):
        if self.at >= len(self.items):
            raise PredicateError("a value is missing")
        kind, v = self.items[self.at]
        self.at += 1
        if kind == "num":
            return float(v) if re.search(r"[.eE]", v) else int(v)
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", v[1:-1])
        if kind == "name":
            return {"true": True, "false": False, "null": None, "none": None}.get(v.lower(), v)
        raise PredicateError(f"{v!r} is no value")

    def test(self) -> Column:
        if self.at >= len(self.items) or self.items[self.at][0] not in ("name", "quoted"):
            raise PredicateError("a column name is missing")
        name = self.items[self.at][1].strip("`")
        self.at += 1
        if self.columns is not None and name not in self.columns:
            raise PredicateError(f"there is no column {name}")
        col = F.col(f"`{name}`")
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return col.isNotNull() if no else col.isNull()
        no = self.take("NOT")
        if self.take("IN"):
            end = ")" if self.take("(") else "]"
            if end == "]":
                self.need("[")
            values = []
            while not self.take(end):
                values.append(self.literal())
                self.take(",")
            out = col.isin(values)
        elif self.take("LIKE"):
            out = col.like(str(self.literal()))
        elif self.take("BETWEEN"):
            low = self.literal()
            self.need("AND")
            out = col.between(low, self.literal())
        elif not no and self.at < len(self.items) and self.items[self.at][0] == "op":
            test = _TESTS[self.items[self.at][1]]
            self.at += 1
            return getattr(col, test)(F.lit(self.literal()))
        elif not no:
            return col.isNotNull()
        else:
            raise PredicateError("NOT needs IN, LIKE or BETWEEN here")
        return ~out if no else out


def parse(text: str, columns: list[str] | None = None) -> Column:
    """The condition that ``text`` states; names outside ``columns`` are refused, where given."""
    p = _Parser(text, set(columns) if columns is not None else None)
    out = p.either()
    if p.at != len(p.items):
        raise PredicateError(f"left over: {p.items[p.at:]}")
    return out
