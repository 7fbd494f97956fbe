"""Chat formatting by a template compiler.

A sandboxed template language is parsed into a syntax tree, constants are folded, and Python closures are generated that
render a conversation into pieces, each marked as generated (under the loss mask) or not. Templates reach nothing but the
names they are given and their fields; there are no calls, imports or Python attributes.

    {{ expression }}                      prints; names, fields (m.text, loop.first), 'strings', numbers, + == != and or not
                                          ( ), and filters: | escape | label | upper | lower | trim
    {% for m in messages %} {% endfor %}  loop.index0, loop.first
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% generation %} {% endgeneration %}  what stands between is generated

Control strings inside texts are escaped with a backslash, reversibly, so that `read_back` finds every turn again.

Rows of a conversation are put in order by turn, then role, then text; null roles and texts are empty, a null turn comes
first, rows with a null conv_id are one conversation. Equal rows are turns of their own. An empty table has no conversation.
A conversation is one row of output, so it must fit a task's memory; other conversations don't add to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, small_batches

TEMPLATE = "{% for m in messages %}### {{ m.role | label }}:\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
CONTROL = re.compile(r"\\|###|</turn>")
LABEL = re.compile(r"[\\:]")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+):\n((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
MOST_NESTED = 50


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def label(role: str) -> str:
    return LABEL.sub(r"\\\g<0>", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "label": label, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    pass


# --- syntax tree -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Apply:
    name: str
    args: tuple


@dataclass(frozen=True)
class Print:
    expr: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


OPERATORS: dict[str, Callable] = {"+": lambda a, b: f"{a}{b}" if isinstance(a, str) or isinstance(b, str) else a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a}
LEXER = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>[0-9]+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>==|!=|[+|().]))")
ESCAPES = {"n": "\n", "t": "\t"}


class Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            if not (m := LEXER.match(source, at)):
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at :]}")

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Apply("or", (left, self.both()))
        return left

    def both(self):
        left = self.inverse()
        while self.take("and"):
            left = Apply("and", (left, self.inverse()))
        return left

    def inverse(self):
        return Apply("not", (self.inverse(),)) if self.take("not") else self.compare()

    def compare(self):
        left = self.sum()
        while op := self.take("==", "!="):
            left = Apply(op, (left, self.sum()))
        return left

    def sum(self):
        left = self.filtered()
        while self.take("+"):
            left = Apply("+", (left, self.filtered()))
        return left

    def filtered(self):
        left = self.atom()
        while self.take("|"):
            kind, name = self.next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            left = Apply("|" + name, (left,))
        return left

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def atom(self):
        kind, text = self.next()
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(text))
        if text == "(":
            inner = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return inner
        if kind == "name" and text in ("true", "false"):
            return Const(text == "true")
        if kind == "name":
            path = [text]
            while self.take("."):
                kind, part = self.next()
                if kind != "name" or part.startswith("_"):
                    raise TemplateError(f"no field {part}")
                path.append(part)
            return Field(tuple(path))
        raise TemplateError(f"not expected: {text}")


PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    items, at = [], 0
    for m in PARTS.finditer(source):
        if m.start() > at:
            items.append(("text", source[at : m.start()]))
        items.append(("print", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        items.append(("text", source[at:]))
    place = 0

    def body(ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        nonlocal place
        if depth > MOST_NESTED:
            raise TemplateError("nested too deeply")
        out = []
        while place < len(items):
            kind, text = items[place]
            place += 1
            word = text.split(None, 1)[0] if kind == "tag" and text else ""
            if kind == "text":
                out.append(Print(Const(text)))
            elif kind == "print":
                out.append(Print(Expression(text).tree))
            elif word in ends:
                return tuple(out), text
            elif word == "for":
                if not (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", text, re.S)):
                    raise TemplateError(f"not understood: {text}")
                inner, _ = body(("endfor",), depth + 1)
                out.append(For(m[1], Expression(m[2]).tree, inner))
            elif word == "if":
                out.append(branch(text[2:], depth))
            elif word == "generation":
                inner, _ = body(("endgeneration",), depth + 1)
                out.append(Generation(inner))
            else:
                raise TemplateError(f"not expected: {text}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), ""

    def branch(test: str, depth: int) -> If:
        yes, end = body(("elif", "else", "endif"), depth + 1)
        if end.startswith("elif"):
            return If(Expression(test).tree, yes, (branch(end[4:], depth + 1),))
        no = body(("endif",), depth + 1)[0] if end == "else" else ()
        return If(Expression(test).tree, yes, no)

    return body((), 0)[0]


def apply(name: str, args: list) -> object:
    if name.startswith("|"):
        return FILTERS[name[1:]](shown(args[0]))
    return OPERATORS[name](*args)


def shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold_expr(e):
    if not isinstance(e, Apply):
        return e
    args = tuple(fold_expr(a) for a in e.args)
    if e.name in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.name == "and") else args[0]
        return Apply(e.name, args)
    if all(isinstance(a, Const) for a in args):
        return Const(apply(e.name, [a.value for a in args]))
    return Apply(e.name, args)


def fold(nodes: Iterable) -> tuple:
    """The tree with constants evaluated, decided branches taken, and neighbouring constant text joined."""
    out: list = []
    for n in nodes:
        if isinstance(n, Print):
            e = fold_expr(n.expr)
            new = (Print(Const(shown(e.value))) if isinstance(e, Const) else Print(e),)
        elif isinstance(n, For):
            new = (For(n.name, fold_expr(n.over), fold(n.body)),)
        elif isinstance(n, Generation):
            new = (Generation(fold(n.body)),)
        else:
            test = fold_expr(n.test)
            new = (fold(n.yes) if test.value else fold(n.no)) if isinstance(test, Const) else (If(test, fold(n.yes), fold(n.no)),)
        for x in new:
            if isinstance(x, Print) and isinstance(x.expr, Const):
                if not x.expr.value:
                    continue
                if out and isinstance(out[-1], Print) and isinstance(out[-1].expr, Const):
                    out[-1] = Print(Const(out[-1].expr.value + x.expr.value))
                    continue
            out.append(x)
    return tuple(out)


Emit = Callable[[str, bool], None]


def value_of(e) -> Callable[[dict], object]:
    if isinstance(e, Const):
        return lambda env, v=e.value: v
    if isinstance(e, Field):
        def field(env: dict, path=e.path):
            for p in path:
                if not isinstance(env, dict) or p not in env:
                    raise TemplateError(f"no {'.'.join(path)}")
                env = env[p]
            return env

        return field
    args = [value_of(a) for a in e.args]
    if e.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.name == "or":
        return lambda env: args[0](env) or args[1](env)
    if e.name.startswith("|"):
        f, a = FILTERS[e.name[1:]], args[0]
        return lambda env: f(shown(a(env)))
    op = OPERATORS[e.name]
    return lambda env: op(*(a(env) for a in args))


def closure(nodes: tuple, generated: bool = False) -> Callable[[dict, Emit], None]:
    steps = [step(n, generated) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, emit: Emit) -> None:
        for s in steps:
            s(env, emit)

    return run


def step(n, generated: bool) -> Callable[[dict, Emit], None]:
    if isinstance(n, Print):
        v = value_of(n.expr)
        if isinstance(n.expr, Const):
            return lambda env, emit, text=n.expr.value: emit(text, generated)
        return lambda env, emit: emit(shown(v(env)), generated)
    if isinstance(n, Generation):
        return closure(n.body, True)
    if isinstance(n, If):
        test, yes, no = value_of(n.test), closure(n.yes, generated), closure(n.no, generated)
        return lambda env, emit: (yes if test(env) else no)(env, emit)
    over, body = value_of(n.over), closure(n.body, generated)

    def loop(env: dict, emit: Emit) -> None:
        for i, x in enumerate(over(env)):
            body({**env, n.name: x, "loop": {"index0": i, "first": i == 0}}, emit)

    return loop


def compiled(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (role, text) to the formatted conversation and its generated spans, in code points."""
    run = closure(fold(parse(template)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        pieces: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def emit(text: str, generated: bool) -> None:
            nonlocal at
            pieces.append(text)
            if generated:
                spans.append((at, at + len(text)))
            at += len(text)

        run({"messages": messages}, emit)
        return "".join(pieces), spans

    return render


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a conversation that TEMPLATE formatted."""
    at = 0
    while at < len(formatted):
        if not (m := TURN.match(formatted, at)):
            raise TemplateError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def formatted(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans): spans under the loss mask, in code points, end exclusive. Rows of a conversation are sorted by Spark, and rendered as they come."""
    render = compiled(template)
    render([{"role": "user", "text": ""}])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        held: list[dict] = []
        last: object = ()

        def done() -> pa.RecordBatch:
            text, spans = render(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([last], type=pa.int64()), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in spans]], type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "formatted", "spans"])

        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held and conv != last:
                    out.append(done())
                last = conv
                held.append({"role": role or "", "text": text or ""})
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if held:
            yield done()

    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, formatted string, spans array<struct<start:long,end:long>>")


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from formatted conversations."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        def f(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, n = hashlib.sha256(), 0
                for role, said in read_back(text):
                    h.update(f"{role}\n{said}\n".encode())
                    n += 1
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                for k, v in zip(out, (n, h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    out[k].append(v)
            return {"conv_id": batch.column(0)} | {k: pa.array(v) for k, v in out.items()}

        return f

    return map_rows(conversations, make, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(formatted(turns.unionByName(own)))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role, '([\\:])', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 14 AS n FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
