"""A sandboxed template language for chats: source text -> syntax tree -> folded tree -> Python closures.

    text {{ expression }} {% for x in expression %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %} {% set name = e %}
    {% generation %} ... {% endgeneration %} {# comment #}

Expressions: or, and, not, == != < <= > >= in, ~ (joins as text), + -, names, .key, [expr], strings,
whole numbers, true, false, none, parentheses, filters (x | name(args)). In a loop, loop has index,
index0, first and last. A dash beside a tag's brace removes the white space next to it.

The sandbox: only keys of mappings and items of lists can be reached, never attributes of Python objects;
there are no calls but of the filters given; loops run over what is given and nest as the source does.
A closure yields pieces of text with a flag, whether they stand inside generation, so that a
conversation of any length streams through.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

TAG = re.compile(r"(\{\{-?)(.*?)(-?\}\})|(\{%-?)(.*?)(-?%\})|(\{#)(.*?)(#\})", re.DOTALL)
TOKEN = re.compile(r"""\s*(?:(?P<word>[A-Za-z_]\w*)|(?P<number>\d+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<sign>==|!=|<=|>=|[-<>~+|.,()\[\]=]))""", re.DOTALL)
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b}
DEEPEST = 64  # nested tags or parentheses


class TemplateError(ValueError):
    """The template isn't well formed, or reaches for what isn't there."""


# --- the tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operation on operands: ``kind`` is an operator, "item", "not", "and", "or" or a filter's "|name"."""

    kind: str
    operands: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class For:
    name: str
    items: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- source to tree


class Expression:
    """Reads one expression by descent: each level of binding is a method."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unknown sign in {source!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at, self.deep = 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        kind, value = self.peek()
        if kind in ("word", "sign") and value in wanted:
            self.at += 1
            return value
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}, found {self.peek()[1]!r}")

    def word(self) -> str:
        kind, value = self.peek()
        if kind != "word":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def whole(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def left(self, lower: Callable, *signs: str):
        tree = lower()
        while sign := self.take(*signs):
            tree = Apply(sign, (tree, lower()))
        return tree

    def either(self):
        self.deep += 1
        if self.deep > DEEPEST:
            raise TemplateError("nested too deeply")
        tree = self.left(lambda: self.left(self.negated, "and"), "or")
        self.deep -= 1
        return tree

    def negated(self):
        n = 0
        while self.take("not"):
            n += 1
        tree = self.left(lambda: self.left(lambda: self.left(self.filtered, "+", "-"), "~"), *COMPARE)
        for _ in range(n):
            tree = Apply("not", (tree,))
        return tree

    def filtered(self):
        tree = self.reached()
        while self.take("|"):
            name, args = self.word(), []
            if self.take("(") and not self.take(")"):
                args.append(self.either())
                while self.take(","):
                    args.append(self.either())
                self.need(")")
            tree = Apply("|" + name, (tree, *args))
        return tree

    def reached(self):
        tree = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                tree = Apply("item", (tree, Const(self.word())))
            else:
                tree = Apply("item", (tree, self.either()))
                self.need("]")
        return tree

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Const(int(value))
        if kind == "word":
            fixed = {"true": True, "false": False, "none": None}
            return Const(fixed[value]) if value in fixed else Name(value)
        if value == "(":
            tree = self.either()
            self.need(")")
            return tree
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The nodes of a template."""
    parts: list = []  # texts as str and tags as (opening, content)
    at, trim = 0, False
    for tag in TAG.finditer(source):
        opening, content, closing = (g for g in tag.groups() if g is not None)
        text = source[at : tag.start()]
        text = text.lstrip() if trim else text
        parts += [text.rstrip() if opening.endswith("-") else text, (opening[:2], content.strip())]
        at, trim = tag.end(), closing.startswith("-")
    parts.append(source[at:].lstrip() if trim else source[at:])
    if any(isinstance(p, str) and re.search(r"\{\{|\{%|\{#|%\}|\}\}", p) for p in parts):
        raise TemplateError("a tag isn't closed")
    nodes, rest = _block(parts, 0, (), 0)
    return nodes


def _block(parts: list, at: int, ends: tuple, deep: int) -> tuple[tuple, int]:
    """Nodes from part ``at`` on to a tag that begins with one of ``ends``; the place of that tag."""
    nodes: list = []
    if deep > DEEPEST:
        raise TemplateError("nested too deeply")
    while at < len(parts):
        part = parts[at]
        if isinstance(part, str):
            nodes += [Text(part)] if part else []
        elif part[0] == "{{":
            nodes.append(Output(Expression(part[1]).whole()))
        elif part[0] == "{%":
            word = part[1].split(None, 1)[0] if part[1] else ""
            rest = part[1][len(word) :]
            if word in ends:
                return tuple(nodes), at
            if word == "for":
                found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.DOTALL)
                if not found:
                    raise TemplateError(f"for what? {part[1]!r}")
                body, at = _block(parts, at + 1, ("endfor",), deep + 1)
                nodes.append(For(found[1], Expression(found[2]).whole(), body))
            elif word == "if":
                node, at = _if(parts, at, rest, deep)
                nodes.append(node)
            elif word == "generation":
                body, at = _block(parts, at + 1, ("endgeneration",), deep + 1)
                nodes.append(Generation(body))
            elif word == "set":
                found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.*)", rest, re.DOTALL)
                if not found:
                    raise TemplateError(f"set what? {part[1]!r}")
                nodes.append(Set(found[1], Expression(found[2]).whole()))
            else:
                raise TemplateError(f"unknown tag {part[1]!r}")
        at += 1
    if ends:
        raise TemplateError(f"no {ends[-1]}")
    return tuple(nodes), at


def _if(parts: list, at: int, test: str, deep: int) -> tuple[If, int]:
    then, at = _block(parts, at + 1, ("elif", "else", "endif"), deep + 1)
    end = parts[at][1]
    if end.startswith("elif"):
        other, at = _if(parts, at, end[4:], deep + 1)
        return If(Expression(test).whole(), then, (other,)), at
    other: tuple = ()
    if end == "else":
        other, at = _block(parts, at + 1, ("endif",), deep + 1)
    return If(Expression(test).whole(), then, other), at


# --- folding


def text_of(value: Any) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The tree with what is constant worked out: an expression, or a tuple of nodes."""
    if isinstance(node, tuple):
        out: list = []
        for n in node:
            n = fold(n, filters)
            if isinstance(n, Output) and isinstance(n.expr, Const):
                n = Text(text_of(n.expr.value))
            if isinstance(n, If) and isinstance(n.test, Const):
                n = n.then if n.test.value else n.other
            if isinstance(n, Generation) and not n.body:
                n = ()
            for one in n if isinstance(n, tuple) else (n,):
                if isinstance(one, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + one.value)
                elif one != Text(""):
                    out.append(one)
        return tuple(out)
    if isinstance(node, Apply):
        if node.kind[0] == "|" and node.kind[1:] not in filters:
            raise TemplateError(f"no filter {node.kind[1:]!r}")
        node = replace(node, operands=tuple(fold(x, filters) for x in node.operands))
        if node.kind in ("and", "or") and isinstance(node.operands[0], Const):
            return node.operands[1] if bool(node.operands[0].value) == (node.kind == "and") else node.operands[0]
        return Const(_expression(node, filters)({})) if all(isinstance(x, Const) for x in node.operands) else node
    if isinstance(node, (Output, Set)):
        return replace(node, expr=fold(node.expr, filters))
    if isinstance(node, For):
        return replace(node, items=fold(node.items, filters), body=fold(node.body, filters))
    if isinstance(node, If):
        return replace(node, test=fold(node.test, filters), then=fold(node.then, filters), other=fold(node.other, filters))
    return replace(node, body=fold(node.body, filters)) if isinstance(node, Generation) else node


# --- closures

Env = dict[str, Any]


def item(value: Any, key: Any) -> Any:
    """A key of a mapping or a place of a list, none if it isn't there; nothing else can be reached."""
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else None
    if value is None:
        return None
    raise TemplateError(f"can't reach {key!r} of {type(value).__name__}")


def _expression(node: Any, filters: Mapping[str, Callable]) -> Callable[[Env], Any]:
    """A closure that works the expression out in an environment of names; names that aren't set are none."""
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    parts = [_expression(x, filters) for x in node.operands]
    kind, a = node.kind, parts[0]
    b = parts[1] if len(parts) > 1 else None
    if kind[0] == "|":
        call, rest = filters[kind[1:]], parts[1:]
        return (lambda env: call(a(env), *[x(env) for x in rest])) if rest else (lambda env: call(a(env)))
    if kind == "item":
        if isinstance(node.operands[1], Const):
            key = node.operands[1].value
            return lambda env: item(a(env), key)
        return lambda env: item(a(env), b(env))
    if kind in COMPARE:
        test = COMPARE[kind]
        return lambda env: _safely(test, a(env), b(env))
    table = {
        "not": lambda env: not a(env), "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env),
        "~": lambda env: text_of(a(env)) + text_of(b(env)), "+": lambda env: _safely(operator.add, a(env), b(env)), "-": lambda env: _safely(operator.sub, a(env), b(env)),
    }
    return table[kind]


def _safely(f: Callable, a: Any, b: Any) -> Any:
    try:
        return f(a, b)
    except TypeError as e:
        raise TemplateError(str(e)) from None


Pieces = Iterator[tuple[str, bool]]


def _nodes(nodes: tuple, filters: Mapping[str, Callable], inside: bool) -> Callable[[Env], Pieces]:
    """A closure that yields the pieces of nodes; ``inside``: they stand in generation."""
    steps = [_node(n, filters, inside) for n in nodes]

    def run(env: Env) -> Pieces:
        for step in steps:
            yield from step(env)

    return run


def _node(node: Any, filters: Mapping[str, Callable], inside: bool) -> Callable[[Env], Iterable[tuple[str, bool]]]:
    if isinstance(node, Text):
        fixed = ((node.value, inside),)
        return lambda env: fixed
    if isinstance(node, Output):
        value = _expression(node.expr, filters)
        return lambda env: ((text_of(value(env)), inside),)
    if isinstance(node, Generation):
        return _nodes(node.body, filters, True)
    if isinstance(node, If):
        test, then, other = _expression(node.test, filters), _nodes(node.then, filters, inside), _nodes(node.other, filters, inside)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(node, Set):
        name, value = node.name, _expression(node.expr, filters)

        def put(env: Env) -> tuple:
            env[name] = value(env)
            return ()

        return put
    name, items, body = node.name, _expression(node.items, filters), _nodes(node.body, filters, inside)

    def loop(env: Env) -> Pieces:
        found = items(env)
        if found is not None and (isinstance(found, (str, bytes, Mapping)) or not isinstance(found, Iterable)):
            raise TemplateError(f"can't loop over {type(found).__name__}")
        outer, rest, end, n = (env.get(name), env.get("loop")), iter(found or ()), object(), 0
        at = next(rest, end)
        while at is not end:
            after = next(rest, end)
            env[name], env["loop"] = at, {"index": n + 1, "index0": n, "first": n == 0, "last": after is end}
            yield from body(env)
            at, n = after, n + 1
        env[name], env["loop"] = outer

    return loop


@dataclass
class Template:
    """A compiled template: ``render(**names)`` yields (text, whether it stands in generation)."""

    source: str
    filters: Mapping[str, Callable] = field(default_factory=dict)

    def __post_init__(self):
        self.tree = fold(parse(self.source), self.filters)
        self._run = _nodes(self.tree, self.filters, False)

    def render(self, **names: Any) -> Pieces:
        return self._run(dict(names))
