"""A sandboxed template language for conversations, compiled to closures, and what reads its output back.

Grammar: text, ``{{ expr }}``, ``{% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}``,
``{% for m in messages %} .. {% endfor %}`` (exactly once in a template, over the conversation) and
``{% generation %} .. {% endgeneration %}``. Expressions: quoted strings, integers, ``m.role``,
``m.text``, ``loop.index``, ``loop.first``, ``loop.last``, ``==``, ``!=``, ``+``, ``not``, ``and``, ``or``,
parentheses and filters (``esc``, ``trim``, ``upper``, ``lower``). There are no calls, attributes of
values, imports or other loops, so a template can't reach anything but its conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ESCAPE = "\\"
#: Rows of formatted text hold about so many characters.
SEGMENT = 1 << 20


# ---- syntax tree


@dataclass
class Node:
    kind: str  # text, out, if, for, gen, block; const, name, not, and, or, ==, !=, +, filter
    value: object = None
    parts: tuple = ()


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_][\w.]*)|(==|!=|[|+()]))""")
FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


class _Expr:
    """Precedence: or, and, not, == and !=, +, filters."""

    def __init__(self, text: str, names: set[str], filters: set[str]) -> None:
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"can't read {text[at:]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at, self.names, self.filters = 0, names, filters

    def peek(self) -> str:
        return self.tokens[self.at][0].strip() if self.at < len(self.tokens) else ""

    def take(self) -> re.Match:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Node:
        node = self.chain("or")
        if self.peek():
            raise TemplateError(f"unexpected {self.peek()!r}")
        return node

    def chain(self, op: str) -> Node:
        below = (lambda: self.chain("and")) if op == "or" else self.negation
        node = below()
        while self.peek() == op:
            self.take()
            node = Node(op, None, (node, below()))
        return node

    def negation(self) -> Node:
        if self.peek() == "not":
            self.take()
            return Node("not", None, (self.negation(),))
        node = self.sum()
        while (op := self.peek()) in ("==", "!="):
            self.take()
            node = Node(op, None, (node, self.sum()))
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while self.peek() == "+":
            self.take()
            node = Node("+", None, (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek() == "|":
            self.take()
            name = self.take()[3]
            if name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            node = Node("filter", name, (node,))
        return node

    def atom(self) -> Node:
        m = self.take()
        if m[1]:
            return Node("const", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1][1:-1], flags=re.S))
        if m[2]:
            return Node("const", int(m[2]))
        if m[3]:
            if m[3] not in self.names:
                raise TemplateError(f"unknown name {m[3]!r}")
            return Node("name", m[3])
        if m[4] == "(":
            node = self.chain("or")
            if self.take()[4] != ")":
                raise TemplateError("a parenthesis stays open")
            return node
        raise TemplateError(f"unexpected {m[0]!r}")


def parse(source: str, filters: Iterable[str] = ()) -> Node:
    tags, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            tags.append(("text", source[at : m.start()]))
        tags.append(("out", m[1]) if m[1] is not None else ("tag", m[2]))
        at = m.end()
    if at < len(source):
        tags.append(("text", source[at:]))
    known = {*FILTERS, *filters, "esc"}
    names: set[str] = set()
    pos, loops = 0, 0

    def expr(text: str) -> Node:
        return _Expr(text, names, known).whole()

    def block(ends: tuple[str, ...], depth: int) -> tuple[Node, str]:
        nonlocal pos, loops
        out: list[Node] = []
        while pos < len(tags):
            kind, text = tags[pos]
            pos += 1
            if kind == "text":
                out.append(Node("text", text))
            elif kind == "out":
                out.append(Node("out", None, (expr(text),)))
            else:
                word = text.split(None, 1)[0] if text else ""
                if word in ends:
                    return Node("block", None, tuple(out)), text
                if word == "if":
                    branches, rest, end = [], None, text
                    while end.split(None, 1)[0] in ("if", "elif"):
                        test = expr((end.split(None, 1) + [""])[1])
                        body, end = block(("elif", "else", "endif"), depth)
                        branches.append((test, body))
                    if end == "else":
                        rest, end = block(("endif",), depth)
                    out.append(Node("if", rest, tuple(branches)))
                elif word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", text)) and not names:
                    names.update({f"{m[1]}.role", f"{m[1]}.text", "loop.index", "loop.first", "loop.last"})
                    body, _ = block(("endfor",), depth + 1)
                    out.append(Node("for", m[1], (body,)))
                    names.clear()
                    loops += 1
                elif word == "generation":
                    body, _ = block(("endgeneration",), depth)
                    out.append(Node("gen", None, (body,)))
                else:
                    raise TemplateError(f"unexpected tag {text!r}")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return Node("block", None, tuple(out)), ""

    tree = block((), 0)[0]
    if loops != 1:
        raise TemplateError(f"a template has one loop over messages, this one {loops}")
    return tree


def fold(node: Node, filters: dict[str, Callable[[str], str]]) -> Node:
    """Constant expressions become constants, decided branches go, texts side by side are joined."""
    if node.kind in ("text", "const", "name"):
        return node
    if node.kind == "if":
        kept = []
        for test, body in ((fold(t, filters), fold(b, filters)) for t, b in node.parts):
            if test.kind != "const":
                kept.append((test, body))
            elif test.value:
                return Node("if", body, tuple(kept)) if kept else body
        rest = fold(node.value, filters) if node.value else Node("block")
        return Node("if", rest, tuple(kept)) if kept else rest
    parts = tuple(fold(p, filters) for p in node.parts)
    if node.kind == "block":
        flat: list[Node] = []
        for p in (x for p in parts for x in (p.parts if p.kind == "block" else (p,))):
            if p.kind == "text" and flat and flat[-1].kind == "text":
                flat[-1] = Node("text", flat[-1].value + p.value)
            elif p.kind != "text" or p.value:
                flat.append(p)
        return Node("block", None, tuple(flat))
    if node.kind == "out" and parts[0].kind == "const":
        return Node("text", _text(parts[0].value))
    folded = Node(node.kind, node.value, parts)
    if node.kind not in ("out", "for", "gen") and all(p.kind == "const" for p in parts):
        return Node("const", _value(folded, filters)({}))
    return folded


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def _value(node: Node, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], object]:
    """The closure of an expression over the names of a turn."""
    sub = [_value(p, filters) for p in node.parts]
    if node.kind == "const":
        return lambda env, v=node.value: v
    if node.kind == "name":
        return lambda env, k=node.value: env[k]
    if node.kind == "not":
        return lambda env, a=sub[0]: not a(env)
    if node.kind == "filter":
        return lambda env, a=sub[0], f=filters[node.value]: f(_text(a(env)))
    a, b = sub
    if node.kind == "and":
        return lambda env: a(env) and b(env)
    if node.kind == "or":
        return lambda env: a(env) or b(env)
    if node.kind == "==":
        return lambda env: a(env) == b(env)
    if node.kind == "!=":
        return lambda env: a(env) != b(env)
    return lambda env: _text(a(env)) + _text(b(env))


Emit = Callable[[str, bool], None]


def _writer(node: Node, filters: dict[str, Callable[[str], str]], loss: bool = False) -> Callable[[dict, Emit], None]:
    """The closure of a template node: it sends its text, and whether the loss covers it, to a sink."""
    if node.kind == "text":
        return lambda env, emit, t=node.value: emit(t, loss)
    if node.kind == "out":
        value = _value(node.parts[0], filters)
        return lambda env, emit: emit(_text(value(env)), loss)
    if node.kind == "gen":
        return _writer(node.parts[0], filters, True)
    if node.kind == "if":
        tests = [(_value(t, filters), _writer(b, filters, loss)) for t, b in node.parts]
        rest = _writer(node.value or Node("block"), filters, loss)

        def choose(env: dict, emit: Emit) -> None:
            for test, body in tests:
                if test(env):
                    return body(env, emit)
            return rest(env, emit)

        return choose
    if node.kind == "for":
        body, name = _writer(node.parts[0], filters, loss), node.value

        def turns(env: dict, emit: Emit) -> None:
            it = iter(env["messages"])
            now, k = next(it, None), 1
            while now is not None:
                after = next(it, None)
                body({f"{name}.role": now[0], f"{name}.text": now[1], "loop.index": k, "loop.first": k == 1, "loop.last": after is None}, emit)
                now, k = after, k + 1

        return turns
    subs = [_writer(p, filters, loss) for p in node.parts]

    def block(env: dict, emit: Emit) -> None:
        for sub in subs:
            sub(env, emit)

    return block


class Template:
    """A compiled template. `controls` are the strings that mark structure; the filter `esc` makes a text free of them.

    An escaped text has ESCAPE doubled and ESCAPE put after the first character of each control string;
    unescape drops each ESCAPE and keeps what follows it. No control string may hold ESCAPE.
    """

    def __init__(self, source: str, controls: list[str]) -> None:
        if any(not c or ESCAPE in c for c in controls):
            raise TemplateError("a control string is empty or holds the escape character")
        self.controls = sorted(controls, key=len, reverse=True)
        self._held = re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)]), re.S)
        self._escaped = re.compile(re.escape(ESCAPE) + "(.)", re.S)
        filters = FILTERS | {"esc": self.escape}
        self.tree = fold(parse(source), filters)
        self._write = _writer(self.tree, filters)

    def escape(self, text: str) -> str:
        return self._held.sub(lambda m: m[0] + ESCAPE, text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def render(self, messages: Iterable[tuple[str, str]], emit: Emit) -> None:
        """Turns may be a lazy sequence: one turn and the next are held at a time."""
        self._write({"messages": messages}, emit)

    def render_text(self, messages: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation and the [start, end) spans under the loss mask."""
        out, spans, at = [], [], 0

        def emit(text: str, loss: bool) -> None:
            nonlocal at
            if loss and text:
                spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)

        self.render(messages, emit)
        return "".join(out), spans


CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
SOURCE = (
    "{% for m in messages %}{% if m.role == 'user' %}<s>[INST]{{ m.text|esc }}[/INST]</s>"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text|esc }}{% endgeneration %}</s>"
    "{% else %}<s>[ROLE]{{ m.role|esc }}[/ROLE]{{ m.text|esc }}</s>{% endif %}{% endfor %}"
)

FORMATTED = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64())))])


def format_conversations(turns: DataFrame, source: str = SOURCE, controls: list[str] = CONTROLS) -> DataFrame:
    """Formatted text of each conversation of turns(conv_id, turn, role, text), in segments.

    Returns conv_id, segment (0, 1, ..), last, text and loss_spans ([start, end) in the segment's text).
    A conversation's segments joined are its formatted text; they come in order, and a segment ends after
    about SEGMENT characters, so memory doesn't grow with a conversation. Rows are ordered by turn (nulls
    first), then role and text; null roles and texts are empty ones; a null conv_id is one conversation;
    repeated rows are turns of their own. One shuffle, by conversation, since a conversation's text and
    any digest of it are sequential.
    """
    common.ensure_workers(turns.sparkSession)
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, controls)
        rows = ((c, (r, t)) for b in batches for lo in range(0, b.num_rows, 256) for c, r, t in zip(*(b.slice(lo, 256).column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        done: list[tuple] = []
        state = {"conv": None, "segment": 0, "size": 0, "parts": [], "spans": []}

        def close(last: bool) -> None:
            done.append((state["conv"], state["segment"], last, "".join(state["parts"]), state["spans"]))
            state.update(segment=state["segment"] + 1, size=0, parts=[], spans=[])

        def emit(text: str, loss: bool) -> None:
            if loss and text:
                state["spans"].append([state["size"], state["size"] + len(text)])
            state["parts"].append(text)
            state["size"] += len(text)
            if state["size"] >= SEGMENT:
                close(False)

        def conversation(head: tuple, rest: Iterator) -> Iterator[tuple[str, str]]:
            nonlocal ahead
            yield head[1]
            for row in rest:
                if row[0] != head[0]:
                    ahead = row
                    return
                yield row[1]
            ahead = None

        ahead = next(rows, None)
        while ahead is not None:
            state.update(conv=ahead[0], segment=0, size=0, parts=[], spans=[])
            turns = conversation(ahead, rows)
            template.render(turns, emit)
            for _ in turns:  # a loop in a branch not taken reads none
                pass
            close(True)
            if sum(len(x[3]) for x in done) >= SEGMENT or len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), FORMATTED, strict=True)], schema=FORMATTED)
                done.clear()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), FORMATTED, strict=True)], schema=FORMATTED)

    return placed.mapInArrow(run, "conv_id long, segment int, last boolean, text string, loss_spans array<array<long>>")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class Reader:
    """Reads a formatted conversation of SOURCE back from its segments, in order."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.marks = re.compile("|".join(re.escape(c) for c in template.controls))
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.role, self.held, self.kind = "", [], "assistant"
        self.tail = self.loss_tail = ""
        self.keep = max(map(len, template.controls)) - 1

    def feed(self, text: str, spans: list[list[int]], last: bool) -> None:
        self.chars += len(text)
        for a, b in spans:
            self._masked(text[a:b])
        buffer, at = self.tail + text, 0
        self.tail = ""
        for m in self.marks.finditer(buffer):
            self.held.append(buffer[at : m.start()])
            at = m.end()
            self._mark(m[0])
        rest = buffer[at:]
        cut = len(rest) if last else max(0, len(rest) - self.keep)
        self.held.append(rest[:cut])
        self.tail = rest[cut:]

    def _masked(self, text: str) -> None:
        text = self.loss_tail + text
        odd = (len(text) - len(text.rstrip(ESCAPE))) % 2
        self.loss_tail = ESCAPE if odd else ""
        plain = self.template.unescape(text[:-1] if odd else text)
        self.loss_chars += len(plain)
        self.loss.update(plain.encode())

    def _mark(self, mark: str) -> None:
        text, self.held = "".join(self.held), []
        if mark == "<s>":
            self.role = "assistant"
        elif mark == "[INST]":
            self.role = "user"
        elif mark == "[/ROLE]":
            self.role = self.template.unescape(text)
        elif mark == "[/INST]":
            self.held = [text]
        elif mark == "</s>":
            self.n_turns += 1
            self.turns.update(f"{self.role}\n{self.template.unescape(text)}\n".encode())

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from format_conversations' segments alone (in its partitions and order)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(SOURCE, CONTROLS)
        reader = Reader(template)
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                reader.feed(row["text"], row["loss_spans"], row["last"])
                if row["last"]:
                    done.append((row["conv_id"], *reader.row()))
                    reader = Reader(template)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(DIGESTS)], schema=DIGESTS)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
