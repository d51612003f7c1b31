"""A small sandboxed template language, compiled to Python closures.

    {{ expr }}                                   output
    {% for x in expr %} ... {% endfor %}         loop.first, loop.last, loop.index0
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expr %}
    {% generation %} ... {% endgeneration %}     text the model is trained on

Expressions: string and integer literals, true, false, none, names,
``a.b`` / ``a["b"]`` (keys of a mapping only), ``+`` (text or numbers), ``==``,
``!=``, ``in``, ``and``, ``or``, ``not``, parentheses and ``| filter``.

Sandbox: names resolve in the given variables alone, access reads mapping keys
and never Python attributes, and the only calls are the registered filters.

``Template(source)`` parses to a syntax tree, folds constants (operators and
pure filters over literals, branches of constant conditions, neighbouring
literal text) and generates closures. ``render`` is lazy: it yields (text,
generated) pieces while it pulls messages from an iterator, so a long
conversation never has to be in memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


# ------------------------------------------------------------------ tree
@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    base: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: Any


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class For:
    name: str
    source: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body); the last condition may be Const(True)


@dataclass(frozen=True)
class Assign:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# ------------------------------------------------------------- expressions
_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<op>==|!=|[+|.()\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LITERALS = {"true": True, "false": False, "none": None}
_WORDS = {"and", "or", "not", "in"}


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text in expression: {source[at:at + 20]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Expression:
    """Recursive descent: or < and < not < comparison < + < filter < access."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want is not None and self.peek() != want:
            raise TemplateError(f"expected {want or 'more'} in expression")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self):
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError("text after the expression")
        return out

    def _chain(self, word: str, below: Callable):
        args = [below()]
        while self.peek() == word:
            self.take()
            args.append(below())
        return args[0] if len(args) == 1 else Op(word, tuple(args))

    def either(self):
        return self._chain("or", lambda: self._chain("and", self.negated))

    def negated(self):
        if self.peek() == "not":
            self.take()
            return Op("not", (self.negated(),))
        left = self.added()
        if self.peek() in ("==", "!=", "in"):
            return Op(self.take()[1], (left, self.added()))
        return left

    def added(self):
        return self._chain("+", self.filtered)

    def filtered(self):
        out = self.access()
        while self.peek() == "|":
            self.take()
            kind, name = self.take()
            if kind != "name":
                raise TemplateError("a filter needs a name")
            out = Filter(name, out)
        return out

    def access(self):
        kind, text = self.take()
        if kind == "str":
            out = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif kind == "int":
            out = Const(int(text))
        elif kind == "name" and text not in _WORDS:
            out = Const(_LITERALS[text]) if text in _LITERALS else Name(text)
        elif text == "(":
            out = self.either()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {text!r} in expression")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                kind, name = self.take()
                if kind != "name":
                    raise TemplateError("a key needs a name")
                out = Key(out, Const(name))
            else:
                out = Key(out, self.either())
                self.take("]")
        return out


# --------------------------------------------------------------- statements
_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", re.S)


def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    pieces = _TAG.split(source)
    for i in range(1, len(pieces), 2):  # {%- and -%} eat white space beside the tag
        if pieces[i][2] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    at = 0

    def body(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        out = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if at % 2:  # literal text
                if piece:
                    out.append(Output(Const(piece)))
                continue
            inner = piece[2:-2].strip("-").strip()
            if piece.startswith("{{"):
                out.append(Output(_Expression(inner).parse()))
                continue
            word, _, rest = inner.partition(" ")
            if word in ends:
                return tuple(out), word, rest
            out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), "", ""

    def statement(word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError("for needs: name in expression")
            return For(m[1], _Expression(m[2]).parse(), body("endfor")[0])
        if word == "if":
            branches, test = [], _Expression(rest).parse()
            while True:
                block, end, more = body("elif", "else", "endif")
                branches.append((test, block))
                if end == "endif":
                    return If(tuple(branches))
                if end == "else":
                    branches.append((Const(True), body("endif")[0]))
                    return If(tuple(branches))
                test = _Expression(more).parse()
        if word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name):
                raise TemplateError("set needs: name = expression")
            return Assign(name.strip(), _Expression(value).parse())
        if word == "generation":
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


# ------------------------------------------------------------------ folding
def _operate(op: str, values: list):
    if op == "+":
        out = values[0]
        for v in values[1:]:
            out = out + v if type(out) is type(v) else f"{_text(out)}{_text(v)}"
        return out
    if op == "==":
        return values[0] == values[1]
    if op == "!=":
        return values[0] != values[1]
    if op == "in":
        return values[0] in values[1]
    if op == "not":
        return not values[0]
    raise TemplateError(op)


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node, filters: dict[str, Callable]):
    """The tree with everything constant computed."""
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if node.op in ("and", "or"):
            stop = node.op == "or"
            left = []
            for a in args:
                if isinstance(a, Const) and bool(a.value) != stop and a is not args[-1]:
                    continue
                left.append(a)
                if isinstance(a, Const) and bool(a.value) == stop:
                    break
            return left[0] if len(left) == 1 else Op(node.op, tuple(left))
        if all(isinstance(a, Const) for a in args):
            return Const(_operate(node.op, [a.value for a in args]))
        return Op(node.op, args)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        arg = fold(node.arg, filters)
        return Const(filters[node.name](_text(arg.value))) if isinstance(arg, Const) else Filter(node.name, arg)
    if isinstance(node, Key):
        return Key(fold(node.base, filters), fold(node.key, filters))
    if isinstance(node, Output):
        return Output(fold(node.expr, filters))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.expr, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.source, filters), fold_body(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold_body(node.body, filters))
    if isinstance(node, If):
        branches = []
        for test, block in node.branches:
            test = fold(test, filters)
            if isinstance(test, Const) and not test.value:
                continue
            branches.append((test, fold_body(block, filters)))
            if isinstance(test, Const):
                break
        return If(tuple(branches))
    return node


def fold_body(body: tuple, filters: dict[str, Callable]) -> tuple:
    out: list = []
    for node in body:
        node = fold(node, filters)
        if isinstance(node, If) and (not node.branches or isinstance(node.branches[0][0], Const)):
            out.extend(node.branches[0][1] if node.branches else ())
        else:
            out.append(node)
    merged: list = []
    for node in out:
        if isinstance(node, Output) and isinstance(node.expr, Const):
            if not _text(node.expr.value):
                continue
            if merged and isinstance(merged[-1], Output) and isinstance(merged[-1].expr, Const):
                merged[-1] = Output(Const(_text(merged[-1].expr.value) + _text(node.expr.value)))
                continue
        merged.append(node)
    return tuple(merged)


# ----------------------------------------------------------------- closures
def _expression(node, filters) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env):
            if name not in env:
                raise TemplateError(f"unknown name {name!r}")
            return env[name]
        return look
    if isinstance(node, Key):
        base, key = _expression(node.base, filters), _expression(node.key, filters)

        def access(env):
            holder = base(env)
            if not isinstance(holder, dict):
                raise TemplateError("only mappings have keys")
            return holder.get(key(env))
        return access
    if isinstance(node, Filter):
        call, arg = filters[node.name], _expression(node.arg, filters)
        return lambda env: call(_text(arg(env)))
    args = [_expression(a, filters) for a in node.args]
    if node.op in ("and", "or"):
        stop = node.op == "or"

        def logic(env):
            value = None
            for a in args:
                value = a(env)
                if bool(value) == stop:
                    break
            return value
        return logic
    op = node.op
    return lambda env: _operate(op, [a(env) for a in args])


def _with_last(items: Iterable) -> Iterator[tuple[Any, bool]]:
    it = iter(items)
    try:
        item = next(it)
    except StopIteration:
        return
    for following in it:
        yield item, False
        item = following
    yield item, True


def _body(nodes: tuple, filters, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    parts = [_statement(n, filters, generated) for n in nodes]
    if len(parts) == 1:
        return parts[0]

    def run(env):
        for p in parts:
            yield from p(env)
    return run


def _statement(node, filters, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Output):
        value = _expression(node.expr, filters)

        def output(env):
            yield _text(value(env)), generated
        return output
    if isinstance(node, Assign):
        name, value = node.name, _expression(node.expr, filters)

        def assign(env):
            env[name] = value(env)
            return iter(())
        return assign
    if isinstance(node, Generation):
        return _body(node.body, filters, True)
    if isinstance(node, If):
        branches = [(_expression(t, filters), _body(b, filters, generated)) for t, b in node.branches]

        def branch(env):
            for test, block in branches:
                if test(env):
                    yield from block(env)
                    return
        return branch
    name, source, block = node.name, _expression(node.source, filters), _body(node.body, filters, generated)

    def loop(env):
        inner = dict(env)
        for i, (item, last) in enumerate(_with_last(source(env))):
            inner[name] = item
            inner["loop"] = {"first": i == 0, "last": last, "index0": i}
            yield from block(inner)
    return loop


@dataclass
class Template:
    source: str
    filters: dict[str, Callable[[str], str]] = field(default_factory=dict)

    def __post_init__(self):
        filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower, **self.filters}
        self.tree = fold_body(parse(self.source), filters)
        self._run = _body(self.tree, filters, False)

    def render(self, **variables) -> Iterator[Piece]:
        """Lazily the (text, generated) pieces, none of them empty."""
        for text, generated in self._run(dict(variables)):
            if text:
                yield text, generated
