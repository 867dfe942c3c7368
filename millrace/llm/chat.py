"""Chat formatting with a compiled template.

The template language has literal text, `{{ expression }}`, `{% for x in xs %}`, `{% if %}` /
`{% elif %}` / `{% else %}`, and `{% generation %}`, which marks what a model is trained to say.
Expressions are names, string and integer literals, `.field`, `==`, `!=`, `and`, `or`, `not`, `+`
and the filters `|esc` and `|line`.  Nothing else parses, so a template can neither call nor import anything.
Source is parsed into a syntax tree, constants are folded, and each node becomes a Python closure
that yields pieces (text, under the loss mask?).

`esc` makes texts safe: a backslash goes before every backslash, `<` and `#`, so no text can hold a
control string, and unescaping drops them again; `line` does so before line ends too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings: a turn's heading is a line `### Role:`, its end is the closing tag.
TEMPLATE = "{% for m in messages %}### {{ m.role|line }}:\n{% if m.role == 'assistant' %}{% generation %}{{ m.text|esc }}{% endgeneration %}{% else %}{{ m.text|esc }}{% endif %}</turn>\n{% endfor %}"

#: Code points after which a conversation's next turn starts a new piece.
PIECE_CHARS = 1 << 16

Piece = tuple[str, bool]
Closure = Callable[[dict], Iterator[Piece]]

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%\s*(.*?)\s*%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|+()]))")
_ESCAPE, _ESCAPE_LINE = re.compile(r"[\\<#]"), re.compile(r"[\\<#\n]")
_UNESCAPE = re.compile(r"\\(.)", re.S)


class TemplateError(ValueError):
    """The template is not in the language."""


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


class _Expression:
    """Recursive descent over one expression's tokens; yields nodes ('kind', ...)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("str", "int", "name", "op"), m.groups(), strict=True) if v is not None))
            at = m.end()
        self.at = 0

    def _next(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in wanted and self.tokens[self.at][0] != "str":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def parse(self) -> tuple:
        node = self._or()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def _or(self) -> tuple:
        node = self._and()
        while self._next("or"):
            node = ("or", node, self._and())
        return node

    def _and(self) -> tuple:
        node = self._not()
        while self._next("and"):
            node = ("and", node, self._not())
        return node

    def _not(self) -> tuple:
        return ("not", self._not()) if self._next("not") else self._compare()

    def _compare(self) -> tuple:
        node = self._sum()
        while op := self._next("==", "!="):
            node = (op, node, self._sum())
        return node

    def _sum(self) -> tuple:
        node = self._filtered()
        while self._next("+"):
            node = ("+", node, self._filtered())
        return node

    def _filtered(self) -> tuple:
        node = self._atom()
        while op := self._next(".", "|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or (op == "|" and name not in ("esc", "line")):
                raise TemplateError(f"unknown name after {op!r}")
            self.at += 1
            node = ("field", node, name) if op == "." else (name, node)
        return node

    def _atom(self) -> tuple:
        if self._next("("):
            node = self._or()
            if not self._next(")"):
                raise TemplateError("missing )")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "int":
            return ("const", int(value))
        if kind == "name" and value not in ("and", "or", "not"):
            return ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """Statements: ('text', s), ('out', e), ('for', name, e, body), ('if', [(e, body)...]), ('generation', body)."""
    root: list[tuple] = []
    stack: list[tuple[str, list, object]] = [("", root, None)]
    at = 0
    for m in _TAG.finditer(source):
        body = stack[-1][1]
        if m.start() > at:
            body.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("out", _Expression(m[1]).parse()))
            continue
        word, _, rest = m[2].partition(" ")
        if word == "for":
            if not (x := re.fullmatch(r"([A-Za-z_]\w*) in (.+)", rest, re.S)):
                raise TemplateError(f"cannot read {m[0]!r}")
            inner: list = []
            body.append(("for", x[1], _Expression(x[2]).parse(), inner))
            stack.append(("for", inner, None))
        elif word == "if":
            inner, arms = [], []
            arms.append((_Expression(rest).parse(), inner))
            body.append(("if", arms))
            stack.append(("if", inner, arms))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            inner, arms = [], stack.pop()[2]
            arms.append((_Expression(rest).parse() if word == "elif" else ("const", True), inner))
            stack.append(("if", inner, arms))
        elif word == "generation":
            inner = []
            body.append(("generation", inner))
            stack.append(("generation", inner, None))
        elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {m[0]!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        root.append(("text", source[at:]))
    return root


def _fold_expression(e: tuple) -> tuple:
    if e[0] in ("const", "name"):
        return e
    parts = tuple(_fold_expression(x) if isinstance(x, tuple) else x for x in e[1:])
    if e[0] != "field" and all(x[0] == "const" for x in parts):
        return ("const", _value((e[0], *parts))({}))
    return (e[0], *parts)


def fold(body: list[tuple]) -> list[tuple]:
    """The same program with constant expressions computed, dead branches cut and texts joined."""
    out: list[tuple] = []
    for s in body:
        if s[0] == "out":
            e = _fold_expression(s[1])
            s = ("text", str(e[1])) if e[0] == "const" else ("out", e)
        elif s[0] == "for":
            s = ("for", s[1], _fold_expression(s[2]), fold(s[3]))
        elif s[0] == "generation":
            s = ("generation", fold(s[1]))
        elif s[0] == "if":
            arms = []
            for test, inner in ((_fold_expression(t), fold(b)) for t, b in s[1]):
                if test[0] != "const" or test[1]:
                    arms.append((test, inner))
                if test[0] == "const" and test[1]:
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    _append(out, x)
                continue
            s = ("if", arms)
        _append(out, s)
    return out


def _append(out: list[tuple], s: tuple) -> None:
    if s[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + s[1])
    elif s != ("text", "") and s != ("if", []):
        out.append(s)


def _value(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n)
    a = _value(e[1])
    if kind == "field":
        return lambda scope, n=e[2]: (x := a(scope)) and x.get(n)
    if kind in ("esc", "line"):
        return lambda scope, p=_ESCAPE if kind == "esc" else _ESCAPE_LINE: p.sub(lambda m: "\\" + m[0], str(a(scope) or ""))
    if kind == "not":
        return lambda scope: not a(scope)
    b = _value(e[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "==":
        return lambda scope: a(scope) == b(scope)
    if kind == "!=":
        return lambda scope: a(scope) != b(scope)
    return lambda scope: a(scope) + b(scope)


def _block(body: list[tuple], masked: bool = False) -> Closure:
    steps = [_statement(s, masked) for s in body]

    def run(scope):
        for step in steps:
            yield from step(scope)

    return run


def _statement(s: tuple, masked: bool) -> Closure:
    if s[0] == "text":
        return lambda scope, piece=(s[1], masked): iter((piece,))
    if s[0] == "out":
        value = _value(s[1])
        return lambda scope: iter(((str(v) if (v := value(scope)) is not None else "", masked),))
    if s[0] == "generation":
        return _block(s[1], True)
    if s[0] == "if":
        arms = [(_value(t), _block(b, masked)) for t, b in s[1]]
        return lambda scope: next((b(scope) for t, b in arms if t(scope)), iter(()))
    each, inner = _value(s[2]), _block(s[3], masked)

    def loop(scope, name=s[1]):
        for x in each(scope) or ():
            yield from inner(scope | {name: x})

    return loop


def compile_template(source: str = TEMPLATE) -> Closure:
    """A closure from {'messages': iterable of {'role', 'text'}} to pieces; it streams."""
    return _block(fold(parse(source)))


_HEAD = re.compile(r"### ((?:[^\\\n]|\\.)*?):\n", re.S)
_END = re.compile(r"(?:[^\\<]|\\.)*", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that the default template formatted."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = _END.match(formatted, head.end()).end()
        if not formatted.startswith("</turn>\n", end):
            raise ValueError("a turn is not closed")
        out.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len("</turn>\n")
    return out


def _pieces(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "piece", "formatted", "mask"])


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, piece, formatted, mask): each conversation in pieces of whole turns, in order.

    `turns` has conv_id, turn, role, text.  Rows go by turn (nulls first), ties by role, then text;
    a null text or role is empty; rows without conv_id are one conversation, whose id stays null.
    Other columns are ignored.  mask lists [from, to) code points of `formatted` that are under the
    loss mask.  A conversation's turns are dealt to one task and stream through it sorted, so a
    task holds a few turns at a time however long the conversation is.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def render(batches):
        program = compile_template(template)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        out: list[tuple] = []
        for conv, group in groupby(rows, key=lambda r: r[0]):
            parts, mask, at, piece, between = [], [], 0, 0, False

            def messages(group=group):
                nonlocal between
                for _, role, text in group:
                    between = True
                    yield {"role": role, "text": text}

            for s, masked in program({"messages": messages()}):
                if between and at >= PIECE_CHARS:
                    out.append((conv, piece, "".join(parts), mask))
                    parts, mask, at, piece = [], [], 0, piece + 1
                    if len(out) >= 64:
                        yield _pieces(out)
                        out = []
                between = False
                if masked and s:
                    mask.append([at, at + len(s)])
                parts.append(s)
                at += len(s)
            out.append((conv, piece, "".join(parts), mask))
            if len(out) >= 64:
                yield _pieces(out)
                out = []
        if out:
            yield _pieces(out)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(render, "conv_id long, piece long, formatted string, mask array<array<long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the pieces alone.

    Pieces come as `format_conversations` leaves them, a conversation in one partition and in order.
    """

    def read(batches):
        current, state = object(), None

        def done():
            return (current, state["n"], state["turns"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["chars"])

        def batch(out):
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            out = []
            for conv, text, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        out.append(done())
                    current, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0}
                for role, said in read_turns(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                for start, end in mask:
                    said = unescape(text[start:end])
                    state["loss"] += len(said)
                    state["masked"].update(said.encode())
                state["chars"] += len(text)
            if out:
                yield batch(out)
        if state is not None:
            yield batch([done()])

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
