r"""Chat formatting: a template compiler that renders conversations and marks what is to be learned.

The template language is a sandboxed subset of the usual one: text, `{{ expression }}`,
`{% for x in xs %}`, `{% if e %} {% elif e %} {% else %} {% endif %}`, `{% endfor %}`, `{% set x = e %}`
and `{% generation %} {% endgeneration %}` around what a model is to learn. Expressions have literals,
names, attributes of rows, `==`, `!=`, `and`, `or`, `not`, `+`, `in`, parentheses and filters from a fixed
list; nothing else can be reached, and a template that asks for more is refused when it is compiled. A
template is parsed into a syntax tree, constant parts are folded, and what is left becomes nested Python
closures, compiled once per task.

Control strings inside texts are escaped reversibly: the escape character itself is doubled, and a
backslash goes into each control string after its first character. So the control strings of the output
are just those that the template wrote, and `read_back` finds every turn again.

Conversations are built where they are: turns are grouped by conv_id, ordered by turn (then role, then
text, so that ties have one order). A conversation is one row of output, so it must fit a task.

Edge cases: null text is empty; null role is the empty role, and is marked like any other; null turns come
first; repeated rows are repeated turns; a null conv_id is a conversation of its own; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the default template.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")

TEMPLATE = """<s>{% for m in turns %}<|turn|>{{ m.role | guard }}<|text|>\
{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}\
<|end|>{% endfor %}</s>"""

ESCAPE = "\\"


class TemplateError(ValueError):
    pass


# Syntax tree: a node is a tuple (kind, ...); ("const", value) is what folding leaves.


@dataclass
class _Parser:
    tokens: list[tuple[str, str]]
    at: int = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self, want: str | None = None) -> str:
        if self.at >= len(self.tokens) or want is not None and self.peek() != want:
            raise TemplateError(f"expected {want or 'more'}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def expression(self):
        left = self.conjunction()
        while self.peek() == "or":
            self.take()
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.peek() == "and":
            self.take()
            left = ("and", left, self.negation())
        return left

    def negation(self):
        if self.peek() == "not":
            self.take()
            return ("not", self.negation())
        left = self.total()
        if self.peek() in ("==", "!=", "in"):
            return (self.take(), left, self.total())
        return left

    def total(self):
        left = self.filtered()
        while self.peek() == "+":
            self.take()
            left = ("+", left, self.filtered())
        return left

    def filtered(self):
        left = self.atom()
        while self.peek() in ("|", "."):
            if self.take() == "|":
                left = ("filter", self.name(), left)
            else:
                left = ("attribute", left, self.name())
        return left

    def name(self) -> str:
        if self.kind() != "name" or self.peek().startswith("_"):
            raise TemplateError(f"not a name: {self.peek()}")
        return self.take()

    def atom(self):
        kind, text = self.kind(), self.peek()
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), self.take()[1:-1]))
        if kind == "number":
            return ("const", int(self.take()))
        if text == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            return inner
        if text in ("true", "false"):
            return ("const", self.take() == "true")
        return ("name", self.name())


_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.+()=]))")


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)

    def block(at: int, ends: tuple[str, ...]) -> tuple[tuple, int, str]:
        body = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                p = _Parser(_tokens(part[2:-2]))
                body.append(("print", p.expression()))
                if p.kind() != "end":
                    raise TemplateError(f"left over: {p.peek()}")
            elif part.startswith("{%"):
                p = _Parser(_tokens(part[2:-2]))
                word = p.name()
                if word in ends:
                    return ("body", body), at, part[2:-2].strip()
                if word == "for":
                    var = p.name()
                    p.take("in")
                    of = p.expression()
                    inner, at, _ = block(at, ("endfor",))
                    body.append(("for", var, of, inner))
                elif word == "if":
                    cases, tail = [(p.expression(), None)], ""
                    while tail != "endif":
                        inner, at, tail = block(at, ("elif", "else", "endif"))
                        cases[-1] = (cases[-1][0], inner)
                        if tail.startswith("elif"):
                            cases.append((_Parser(_tokens(tail[4:])).expression(), None))
                        elif tail == "else":
                            cases.append((("const", True), None))
                    body.append(("if", cases))
                elif word == "set":
                    var = p.name()
                    p.take("=")
                    body.append(("set", var, p.expression()))
                elif word == "generation":
                    inner, at, _ = block(at, ("endgeneration",))
                    body.append(("generation", inner))
                else:
                    raise TemplateError(f"unknown tag: {word}")
            elif part:
                body.append(("print", ("const", part)))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return ("body", body), at, ""

    return block(0, ())[0]


_TWO = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else str(a) + str(b)}


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """The same tree with constant expressions, cases and runs of text worked out."""
    kind = node[0]
    if kind in _TWO:
        a, b = fold(node[1], filters), fold(node[2], filters)
        return ("const", _TWO[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind in ("and", "or"):
        a, b = fold(node[1], filters), fold(node[2], filters)
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "not":
        a = fold(node[1], filters)
        return ("const", not a[1]) if a[0] == "const" else (kind, a)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter: {node[1]}")
        a = fold(node[2], filters)
        return ("const", filters[node[1]](a[1])) if a[0] == "const" else (kind, node[1], a)
    if kind == "attribute":
        return (kind, fold(node[1], filters), node[2])
    if kind == "print":
        return (kind, fold(node[1], filters))
    if kind == "set":
        return (kind, node[1], fold(node[2], filters))
    if kind == "for":
        return (kind, node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "generation":
        return (kind, fold(node[1], filters))
    if kind == "if":
        cases = []
        for test, inner in node[1]:
            test = fold(test, filters)
            if test[0] == "const" and not test[1]:
                continue
            cases.append((test, fold(inner, filters)))
            if test[0] == "const":
                break
        return cases[0][1] if cases and cases[0][0][0] == "const" else (kind, cases)
    if kind == "body":
        out: list = []
        for x in (fold(x, filters) for x in node[1]):
            for y in x[1] if x[0] == "body" else [x]:
                if y[0] == "print" and y[1][0] == "const" and out and out[-1][0] == "print" and out[-1][1][0] == "const":
                    out[-1] = ("print", ("const", str(out[-1][1][1]) + str(y[1][1])))
                else:
                    out.append(y)
        return (kind, out)
    return node


class _Output:
    """Pieces written so far and, as pairs of places, the spans to be learned."""

    def __init__(self):
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _value(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":

        def name(scope, n=node[1]):
            if n not in scope:
                raise TemplateError(f"unknown name: {n}")
            return scope[n]

        return name
    if kind == "attribute":
        of = _value(node[1], filters)

        def attribute(scope, n=node[2]):
            row = of(scope)
            if not isinstance(row, dict) or n not in row:
                raise TemplateError(f"no such field: {n}")
            return row[n]

        return attribute
    if kind == "filter":
        f, of = filters[node[1]], _value(node[2], filters)
        return lambda scope: f(of(scope))
    if kind == "not":
        of = _value(node[1], filters)
        return lambda scope: not of(scope)
    a, b = _value(node[1], filters), _value(node[2], filters)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope, f=_TWO[kind]: f(a(scope), b(scope))


def _statement(node: tuple, filters: dict[str, Callable]) -> Callable[[dict, _Output], None]:
    kind = node[0]
    if kind == "print":
        if node[1][0] == "const":
            return lambda scope, out, text=str(node[1][1]): out.write(text)
        of = _value(node[1], filters)
        return lambda scope, out: out.write(str(of(scope)))
    if kind == "set":
        of = _value(node[2], filters)
        return lambda scope, out, n=node[1]: scope.__setitem__(n, of(scope))
    if kind == "body":
        steps = [_statement(x, filters) for x in node[1]]

        def body(scope, out):
            for step in steps:
                step(scope, out)

        return body
    if kind == "for":
        of, inner = _value(node[2], filters), _statement(node[3], filters)

        def loop(scope, out, n=node[1]):
            for x in of(scope):
                inner({**scope, n: x}, out)

        return loop
    if kind == "generation":
        inner = _statement(node[1], filters)

        def generation(scope, out):
            start = out.length
            inner(scope, out)
            out.spans.append((start, out.length))

        return generation
    cases = [(_value(test, filters), _statement(inner, filters)) for test, inner in node[1]]

    def choose(scope, out):
        for test, inner in cases:
            if test(scope):
                inner(scope, out)
                return

    return choose


def guards(control: tuple[str, ...] = CONTROL) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """(escape, unescape) for texts among these control strings."""
    find = re.compile("|".join([re.escape(ESCAPE), *map(re.escape, sorted(control, key=len, reverse=True))]))

    def escape(text: str) -> str:
        return find.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + "." + m[0][1:], text)

    back = re.compile(re.escape(ESCAPE) + "(.)", re.S)

    def unescape(text: str) -> str:
        return back.sub(lambda m: ESCAPE if m[1] == ESCAPE else "", text)

    return escape, unescape


def compile_template(template: str = TEMPLATE, control: tuple[str, ...] = CONTROL) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from turns (role, text) to (formatted text, spans to be learned)."""
    filters = {"guard": guards(control)[0], "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower()}
    run = _statement(fold(parse(template), filters), filters)

    def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        run({"turns": turns}, out)
        return "".join(out.pieces), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of what the default template wrote."""
    unescape = guards()[1]
    if not (formatted.startswith("<s>") and formatted.endswith("</s>")):
        raise ValueError("not a formatted conversation")
    turns, at, end = [], 3, len(formatted) - 4
    while at < end:
        m = formatted.index("<|text|>", at)
        stop = formatted.index("<|end|>", m)
        if not formatted.startswith("<|turn|>", at):
            raise ValueError("not a turn")
        turns.append((unescape(formatted[at + 8 : m]), unescape(formatted[m + 8 : stop])))
        at = stop + 7
    return turns


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted and loss (spans of code points, [start, end)) of every conversation."""
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        for b in batches:
            out = [render([{"role": t["role"], "text": t["text"]} for t in turns]) for turns in b.turns]
            yield pd.DataFrame({"conv_id": b.conv_id, "formatted": [x[0] for x in out], "loss": [[{"start": s, "end": e} for s, e in x[1]] for x in out]})

    return whole.mapInPandas(run, "conv_id long, formatted string, loss array<struct<start: int, end: int>>")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of turns and of learned text, read back from the output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unescape = guards()[1]
        for b in batches:
            rows = []
            for text, spans in zip(b.formatted, b.loss):
                turns = read_back(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                all_turns = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), _sha(all_turns), len(learned), _sha(learned), len(text)))
            yield pd.concat([b[["conv_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])], axis=1)

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
