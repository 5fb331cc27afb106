"""The call language: text to a tree of calls."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

_TOKEN = re.compile(
    r"""\s*(?:(?P<time>\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d+)?)?Z?|\d{4}-\d\d-\d\d(?!\d))|(?P<number>-?\d+(?:\.\d+)?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
    r"""|(?P<name>\$?[A-Za-z_][A-Za-z0-9_-]*)|(?P<op>><|==|!=|<=|>=|[<>=(),\[\]]))"""
)


class CallError(ValueError):
    """A text that is no call, or a call that can't be answered."""


@dataclass(frozen=True)
class Condition:
    """A comparison of a field; between forms carry both ends, as (low op, low, high op, high)."""

    op: str
    value: Any


@dataclass
class Call:
    name: str
    children: list[Call] = field(default_factory=list)
    args: dict[str, Any] = field(default_factory=dict)
    positional: list[Any] = field(default_factory=list)


@dataclass(frozen=True)
class Name:
    """A bare word: a field's name or an unquoted key."""

    text: str


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise CallError(f"unexpected character at {at}: {text[at : at + 12]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str, variables: dict[str, Any]):
        self.tokens, self.at, self.variables = _tokens(text), 0, variables

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def take(self, want: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if want is not None and got[1] != want:
            raise CallError(f"expected {want!r}, got {got[1]!r}")
        self.at += 1
        return got

    def calls(self) -> list[Call]:
        out = []
        while self.peek()[0] != "end":
            out.append(self.call())
        return out

    def call(self) -> Call:
        kind, name = self.take()
        if kind != "name":
            raise CallError(f"expected a call, got {name!r}")
        self.take("(")
        out = Call(name.lower())
        while self.peek()[1] != ")":
            self.argument(out)
            if self.peek()[1] == ",":
                self.take()
            elif self.peek()[1] != ")":
                raise CallError(f"expected ',' or ')', got {self.peek()[1]!r}")
        self.take(")")
        return out

    def argument(self, out: Call) -> None:
        kind, text = self.peek()
        after = self.peek(1)[1]
        if kind == "name" and after == "(":
            out.children.append(self.call())
        elif kind == "name" and after in ("=", "==", "!=", "<", "<=", ">", ">=", "><"):
            self.take()
            op = self.take()[1]
            value = self.value()
            out.args[text] = value if op == "=" else Condition(op, value)
        elif kind in ("number", "time", "string") and after in ("<", "<="):
            low, low_op = self.value(), self.take()[1]
            name = self.take()[1]
            high_op, high = self.take()[1], self.value()
            out.args[name] = Condition("between", (low_op, low, high_op, high))
        else:
            out.positional.append(self.value())

    def value(self) -> Any:
        kind, text = self.peek()
        if kind == "name" and self.peek(1)[1] == "(":
            return self.call()
        self.take()
        if kind == "number":
            return Decimal(text) if "." in text else int(text)
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "name" and text.startswith("$"):
            if text[1:] not in self.variables:
                raise CallError(f"variable {text} has no value")
            return self.variables[text[1:]]
        if kind == "name":
            low = text.lower()
            return {"null": None, "true": True, "false": False}[low] if low in ("null", "true", "false") else Name(text)
        if kind == "time":
            return text
        if text == "[":
            items = []
            while self.peek()[1] != "]":
                items.append(self.value())
                if self.peek()[1] == ",":
                    self.take()
            self.take("]")
            return [x.text if isinstance(x, Name) else x for x in items]
        raise CallError(f"unexpected {text!r}")


def parse(text: str, variables: dict[str, Any] | None = None) -> list[Call]:
    """All calls of a text, in order; $x stands for a variable's value."""
    return _Parser(text, variables or {}).calls()
