"""A small template language for conversations, compiled to Python closures.

    {{ expression }}            writes a value
    {% for m in messages %} .. {% endfor %}    loops over a list; loop.index0, loop.first, loop.last
    {% if a %} .. {% elif b %} .. {% else %} .. {% endif %}
    {% set name = expression %}
    {% generation %} .. {% endgeneration %}    marks what is written inside as generated text

Expressions: 'text', "text", integers, true, false, none, names, a.field, a[index], not, and, or, == != < <= > >=, in,
+ - * ~ (joins as text), %, ( ), and the filters `| trim`, `| upper`, `| lower`, `| length`, `| escape`. Tags drop no white
space around them unless written {%- or -%}. The sandbox has values of four kinds only (text, integers, truth and
none, lists and mappings of these): fields are keys of mappings, never Python attributes, nothing can be called, loops
run over given lists alone, and a text that grows past MAX_TEXT or a number past MAX_NUMBER ends the rendering.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

MAX_TEXT, MAX_NUMBER = 1 << 28, 1 << 62

_TAG = re.compile(r"(\{\{-?|\{%-?)(.*?)(-?\}\}|-?%\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+*~%<>()\[\].,|=]))""", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The template is not of the language, or left the sandbox when it ran."""


class Node(NamedTuple):
    """A syntax tree node: what it is, its plain values, its parts."""

    kind: str
    value: object = None
    parts: tuple = ()


class Rendered(NamedTuple):
    """The text and the (start, stop) of its generated stretches, in code points."""

    text: str
    spans: list[tuple[int, int]]


# Parsing


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        kind, word = m.lastgroup, m[m.lastgroup]
        value = re.sub(r"\\(.)", lambda x: _ESCAPED.get(x[1], x[1]), word[1:-1], flags=re.S) if kind == "text" else int(word) if kind == "number" else word
        out.append((kind, value))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing over the tokens of one tag."""

    LEVELS = [("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "%")]

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted: object) -> object:
        kind, value = self.peek()
        if wanted and (kind == "text" or value not in wanted):
            raise TemplateError(f"expected {wanted[0]!r} instead of {value!r}")
        self.at += 1
        return value

    def name(self) -> str:
        if self.peek()[0] != "name":
            raise TemplateError(f"expected a name instead of {self.peek()[1]!r}")
        return self.take()

    def whole(self) -> Node:
        out = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"{self.peek()[1]!r} is left over")
        return out

    def level(self, k: int) -> Node:
        if k == 2 and self.peek() == ("name", "not"):
            self.take()
            return Node("not", None, (self.level(2),))
        if k == len(self.LEVELS):
            return self.postfix()
        left = self.level(k + 1)
        while self.peek()[0] in ("name", "sign") and self.peek()[1] in self.LEVELS[k]:
            left = Node("op", self.take(), (left, self.level(k + 1)))
        return left

    def postfix(self) -> Node:
        out = self.atom()
        while self.peek()[0] == "sign" and self.peek()[1] in (".", "[", "|"):
            sign = self.take()
            if sign == ".":
                out = Node("item", None, (out, Node("const", self.name())))
            elif sign == "[":
                out = Node("item", None, (out, self.level(0)))
                self.take("]")
            else:
                out = Node("filter", self.name(), (out,))
        return out

    def atom(self) -> Node:
        kind, value = self.peek()
        self.at += 1
        if kind in ("text", "number"):
            return Node("const", value)
        if kind == "name" and value in ("true", "false", "none"):
            return Node("const", {"true": True, "false": False, "none": None}[value])
        if kind == "name":
            return Node("name", value)
        if (kind, value) == ("sign", "-"):
            return Node("op", "-", (Node("const", 0), self.postfix()))
        if (kind, value) == ("sign", "("):
            out = self.level(0)
            self.take(")")
            return out
        raise TemplateError(f"unexpected {value!r}")


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, text): literal text, expressions and statements, white space cut where tags say so."""
    out, at, cut = [], 0, False
    for m in _TAG.finditer(source):
        if (m[1][1] == "{") != (m[3][-2] == "}"):
            raise TemplateError(f"tag {m[0]!r} does not close as it opens")
        literal = source[at : m.start()]
        literal = literal.lstrip() if cut else literal
        out.append(("text", literal.rstrip() if m[1].endswith("-") else literal))
        out.append(("write" if m[1][1] == "{" else "do", m[2]))
        at, cut = m.end(), m[3].startswith("-")
    rest = source[at:].lstrip() if cut else source[at:]
    if re.search(r"\{\{|\{%", rest):
        raise TemplateError("a tag is not closed")
    return [p for p in [*out, ("text", rest)] if p[0] != "text" or p[1]]


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces, at = _pieces(source), 0

    def block(*ends: str) -> tuple[Node, str]:
        nonlocal at
        parts = []
        while at < len(pieces):
            kind, body = pieces[at]
            at += 1
            if kind == "text":
                parts.append(Node("text", body))
            elif kind == "write":
                parts.append(Node("write", None, (_Expression(body).whole(),)))
            else:
                e = _Expression(body)
                word = e.name()
                if word in ends:
                    at -= 1
                    return Node("block", None, tuple(parts)), word
                parts.append(statement(word, e))
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return Node("block", None, tuple(parts)), ""

    def closing() -> _Expression:
        nonlocal at
        e = _Expression(pieces[at][1])
        at += 1
        e.name()
        return e

    def bare(e: _Expression) -> None:
        if e.peek()[0] != "end":
            raise TemplateError(f"{e.peek()[1]!r} is left over")

    def statement(word: str, e: _Expression) -> Node:
        if word == "set":
            name = e.name()
            e.take("=")
            return Node("set", name, (e.whole(),))
        if word == "for":
            name = e.name()
            e.take("in")
            over = e.whole()
            body, _ = block("endfor")
            bare(closing())
            return Node("for", name, (over, body))
        if word == "generation":
            bare(e)
            body, _ = block("endgeneration")
            bare(closing())
            return Node("generation", None, (body,))
        if word == "if":
            test, otherwise = e.whole(), Node("block")
            body, end = block("elif", "else", "endif")
            following = closing()
            if end == "elif":
                return Node("if", None, (test, body, statement("if", following)))
            bare(following)
            if end == "else":
                otherwise, _ = block("endif")
                bare(closing())
            return Node("if", None, (test, body, otherwise))
        raise TemplateError(f"unknown statement {word!r}")

    return block()[0]


# Values


def _text(value: object) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value) if isinstance(value, (str, int)) else _refuse(value)


def _refuse(value: object) -> str:
    raise TemplateError(f"a {type(value).__name__} cannot be written")


def _item(of: object, key: object) -> object:
    if isinstance(of, dict):
        return of.get(key) if isinstance(key, str) else None
    if isinstance(of, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _number(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TemplateError(f"{value!r} is no number")
    return value


def _bounded(value: object) -> object:
    if isinstance(value, str) and len(value) > MAX_TEXT or isinstance(value, int) and abs(value) > MAX_NUMBER:
        raise TemplateError("a value outgrew the sandbox")
    return value


def _plus(a: object, b: object) -> object:
    return a + b if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b)


def _below(a: object, b: object) -> bool:
    return a < b if isinstance(a, str) and isinstance(b, str) else _number(a) < _number(b)


def _modulo(a: object, b: object) -> int:
    if _number(b) == 0:
        raise TemplateError("modulo by zero")
    return _number(a) % b


OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: type(a) is type(b) and a == b, "!=": lambda a, b: type(a) is not type(b) or a != b,
    "<": _below, ">": lambda a, b: _below(b, a), "<=": lambda a, b: not _below(b, a), ">=": lambda a, b: not _below(a, b),
    "in": lambda a, b: a in b if isinstance(b, (list, dict)) or isinstance(a, str) and isinstance(b, str) else _refuse(b),
    "+": _plus, "-": lambda a, b: _number(a) - _number(b), "*": lambda a, b: _number(a) * _number(b), "%": _modulo, "~": lambda a, b: _text(a) + _text(b),
}


class Escape:
    """Breaks control strings inside texts by a backslash after their first character; plain() undoes it exactly.

    A control string starts with a character that no control string holds again, so that occurrences never overlap
    and breaking one makes no other.
    """

    def __init__(self, control: list[str]):
        bad = [c for c in control if len(c) < 2 or "\\" in c or any(c[0] in d[1:] for d in control)]
        if bad or not control:
            raise TemplateError(f"unusable control strings {bad}")
        self.control = sorted(control, key=lambda c: (-len(c), c))
        self.marks = re.compile("|".join(map(re.escape, self.control)))
        self._to_break, self._broken = re.compile(r"\\|" + self.marks.pattern), re.compile(r"\\(\\)?")

    def __call__(self, text: str) -> str:
        return self._to_break.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def plain(self, text: str) -> str:
        return self._broken.sub(lambda m: m[1] or "", text)


def _filters(escape: Escape | None) -> dict[str, Callable]:
    out = {"trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0}
    return out | ({"escape": lambda v: escape(_text(v))} if escape else {})


# Folding


def fold(node: Node, filters: dict[str, Callable] | None = None) -> Node:
    """The tree with constant expressions worked out, constant branches chosen and neighbouring texts joined.

    What would fail when it runs is left to fail then, as its branch may never run.
    """
    filters = _filters(None) if filters is None else filters
    parts = tuple(fold(p, filters) for p in node.parts)
    node = Node(node.kind, node.value, parts)
    constant = all(p.kind == "const" for p in parts)
    try:
        if node.kind == "op" and node.value in ("and", "or") and parts[0].kind == "const":
            return parts[1] if bool(parts[0].value) == (node.value == "and") else parts[0]
        if node.kind == "op" and node.value in OPERATIONS and constant:
            return Node("const", _bounded(OPERATIONS[node.value](parts[0].value, parts[1].value)))
        if node.kind == "not" and constant:
            return Node("const", not parts[0].value)
        if node.kind == "item" and constant:
            return Node("const", _item(parts[0].value, parts[1].value))
        if node.kind == "filter" and constant and node.value in filters:
            return Node("const", _bounded(filters[node.value](parts[0].value)))
        if node.kind == "write" and constant:
            return Node("text", _text(parts[0].value))
    except TemplateError:
        return node
    if node.kind == "if" and parts[0].kind == "const":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "block":
        flat = []
        for p in parts:
            for q in p.parts if p.kind == "block" else (p,):
                if q.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + q.value)
                elif q.kind != "text" or q.value:
                    flat.append(q)
        return Node("block", None, tuple(flat))
    return node


# Closures


class _Sink:
    """What a rendering has written: pieces, their length, and the generated stretches."""

    __slots__ = ("pieces", "length", "spans", "open")

    def __init__(self) -> None:
        self.pieces, self.length, self.spans, self.open = [], 0, [], False

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)
        if self.length > MAX_TEXT:
            raise TemplateError("the text outgrew the sandbox")


def _value(node: Node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if node.kind == "const":
        return lambda scope, v=node.value: v
    if node.kind == "name":
        return lambda scope, n=node.value: scope.get(n)
    inner = [_value(p, filters) for p in node.parts]
    if node.kind == "item":
        return lambda scope, a=inner[0], b=inner[1]: _item(a(scope), b(scope))
    if node.kind == "not":
        return lambda scope, a=inner[0]: not a(scope)
    if node.kind == "filter":
        if node.value not in filters:
            raise TemplateError(f"unknown filter {node.value!r}")
        return lambda scope, f=filters[node.value], a=inner[0]: _bounded(f(a(scope)))
    a, b = inner
    if node.value == "and":
        return lambda scope: a(scope) and b(scope)
    if node.value == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope, f=OPERATIONS[node.value]: _bounded(f(a(scope), b(scope)))


def _writer(node: Node, filters: dict[str, Callable]) -> Callable[[dict, _Sink], None]:
    if node.kind == "text":
        return lambda scope, sink, t=node.value: sink.write(t)
    if node.kind == "write":
        return lambda scope, sink, v=_value(node.parts[0], filters): sink.write(_text(v(scope)))
    if node.kind == "set":
        return lambda scope, sink, n=node.value, v=_value(node.parts[0], filters): scope.__setitem__(n, v(scope))
    if node.kind == "block":
        steps = [_writer(p, filters) for p in node.parts]

        def block(scope: dict, sink: _Sink) -> None:
            for step in steps:
                step(scope, sink)

        return block
    if node.kind == "if":
        test, yes, no = _value(node.parts[0], filters), _writer(node.parts[1], filters), _writer(node.parts[2], filters)
        return lambda scope, sink: (yes if test(scope) else no)(scope, sink)
    if node.kind == "generation":
        body = _writer(node.parts[0], filters)

        def generation(scope: dict, sink: _Sink) -> None:
            if sink.open:
                raise TemplateError("generation marks do not nest")
            sink.open, start = True, sink.length
            body(scope, sink)
            sink.open = False
            sink.spans.append((start, sink.length))

        return generation
    over, body, name = _value(node.parts[0], filters), _writer(node.parts[1], filters), node.value

    def loop(scope: dict, sink: _Sink) -> None:
        items = over(scope)
        if not isinstance(items, list):
            raise TemplateError("only lists can be looped over")
        # Names set inside a loop end with it.
        for k, item in enumerate(items):
            body({**scope, name: item, "loop": {"index0": k, "first": k == 0, "last": k == len(items) - 1}}, sink)

    return loop


def compile_template(source: str, control: list[str] | None = None) -> Callable[[dict], Rendered]:
    """A closure that renders the template over a mapping of names; `control` are the strings that `| escape` breaks."""
    filters = _filters(Escape(control) if control else None)
    write = _writer(fold(parse(source), filters), filters)

    def render(names: dict) -> Rendered:
        sink = _Sink()
        write(dict(names), sink)
        return Rendered("".join(sink.pieces), sink.spans)

    return render
