"""Chat formatting: a compiler for a small, sandboxed template language.

A template is parsed into a syntax tree, constant parts are folded, and the tree is compiled to Python
closures that stream (text, under the loss mask) chunks. Templates have no attribute access beyond the
fields of a message, no calls beyond the filters given here, and no way to reach Python objects.

Language: text, ``{{ expression }}``, comments ``{# ... #}`` and ``{% statement %}``, each with a dash inside its ends to
trim the white space of the text beyond it, and the statements
``for NAME in messages ... endfor``, ``if E ... elif E ... else ... endif``, ``generation ... endgeneration``
(the loss mask) and ``set NAME = E``. Expressions: strings, integers, ``true``/``false``/``none``, names,
``NAME.field``, ``loop.index``/``loop.index0``/``loop.first``/``loop.last``, ``+``, ``==``, ``!=``, ``in``, ``not``, ``and``,
``or``, parentheses, and filters ``| escape``, ``| line``, ``| trim``, ``| upper``, ``| lower``.

Messages are consumed one at a time, so a conversation of any length is rendered in bounded memory. They pass by once, so
a template has one loop over them; a second one is an error.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import lean

Chunk = tuple[str, bool]
Scope = dict[str, Any]

_ESCAPE = re.compile(r"\\|<(?=\|)")
_LINE = re.compile(r"\\|\n|<(?=\|)")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Reversibly rids ``text`` of control strings: a backslash doubles, ``<|`` becomes ``<\\|``."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\", text)


def line(text: str) -> str:
    """``escape`` that also keeps the text on one line."""
    return _LINE.sub(lambda m: {"\\": "\\\\", "\n": "\\n", "<": "<\\"}[m[0]], text)


def unescape(text: str) -> str:
    """Inverse of ``escape`` and ``line``."""
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is not in the language."""


# --- syntax tree -----------------------------------------------------------------------------
# expressions: ("const", v) ("name", n) ("field", n, f) ("not", e) ("filter", e, f) (op, a, b)
# statements: ("out", e) ("for", n, body) ("if", [(e, body)], body) ("mask", body) ("set", n, e)

_INSIDE = r"((?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|(?!-?[%}]\}).)*)"
_TAG = re.compile(rf"\{{\{{(-?){_INSIDE}(-?)\}}\}}|\{{%(-?){_INSIDE}(-?)%\}}|\{{#(-?).*?(-?)#\}}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.+|()]))")
_WORDS = {"true": True, "false": False, "none": None}
_STRING_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive-descent parser of one expression, folding constants as it goes."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *values: str) -> str | None:
        if (v := self.peek()) in values:
            self.at += 1
            return v
        return None

    def parse(self) -> tuple:
        tree = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = fold(("or", tree, self.both()))
        return tree

    def both(self) -> tuple:
        tree = self.negation()
        while self.take("and"):
            tree = fold(("and", tree, self.negation()))
        return tree

    def negation(self) -> tuple:
        return fold(("not", self.negation())) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        tree = self.total()
        while op := self.take("==", "!=", "in"):
            tree = fold((op, tree, self.total()))
        return tree

    def total(self) -> tuple:
        tree = self.filtered()
        while self.take("+"):
            tree = fold(("+", tree, self.filtered()))
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = fold(("filter", tree, name))
        return tree

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "int":
            return ("const", int(value))
        if value == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is open")
            return tree
        if kind != "name" or value in ("and", "or", "not", "in"):
            raise TemplateError(f"unexpected {value!r}")
        if value in _WORDS:
            return ("const", _WORDS[value])
        if self.take("."):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"no field {name!r}")
            self.at += 1
            return ("field", value, name)
        return ("name", value)


def fold(tree: tuple) -> tuple:
    """The tree, or its value where all parts are constant."""
    if all(isinstance(part, tuple) and part[0] == "const" for part in tree[1:] if isinstance(part, tuple)):
        return ("const", _expression(tree)({}))
    return tree


def parse(template: str) -> list[tuple]:
    """Statements of a template; neighbouring constant text is folded into one output."""
    items: list[tuple[str, str]] = []
    at, trim = 0, False

    def between(upto: int, trim_end: bool) -> None:
        text = template[at:upto]
        if lost := re.search(r"\{\{|\{%", text):
            raise TemplateError(f"cannot read {text[lost.start() :][:40]!r}")
        text = text.lstrip() if trim else text
        items.append(("text", text.rstrip() if trim_end else text))

    for m in _TAG.finditer(template):
        between(m.start(), "-" in (m[1], m[4], m[7]))
        at, trim = m.end(), "-" in (m[3], m[6], m[8])
        if m[2] is not None:
            items.append(("out", m[2]))
        elif m[5] is not None:
            items.append(("tag", m[5].strip()))
    between(len(template), False)
    stream = iter(items)
    loops = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal loops
        body: list[tuple] = []
        for kind, value in stream:
            word = value.split(None, 1)[0] if value.split() else ""
            if kind == "text" or kind == "out":
                tree = ("const", value) if kind == "text" else _Expression(value).parse()
                if tree[0] == "const" and body and body[-1][0] == "out" and body[-1][1][0] == "const":
                    body[-1] = ("out", ("const", _text(body[-1][1][1]) + _text(tree[1])))
                elif tree != ("const", ""):
                    body.append(("out", tree))
            elif word in ends:
                return body, value
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+messages", value)
                if not m:
                    raise TemplateError(f"cannot read {value!r}")
                loops += 1
                if loops > 1:
                    raise TemplateError("a template has one loop over messages")
                body.append(("for", m[1], block("endfor")[0]))
            elif word == "if":
                cases, test = [], value[2:]
                while True:
                    inner, end = block("elif", "else", "endif")
                    cases.append((_Expression(test).parse(), inner))
                    if not end.startswith("elif"):
                        break
                    test = end[4:]
                otherwise = block("endif")[0] if end.startswith("else") else []
                body += _fold_if(cases, otherwise)
            elif word == "generation":
                body.append(("mask", block("endgeneration")[0]))
            elif word == "set" and (m := re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=(.*)", value, re.DOTALL)):
                body.append(("set", m[1], _Expression(m[2]).parse()))
            else:
                raise TemplateError(f"unexpected {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, ""

    return block()[0]


def _fold_if(cases: list[tuple], otherwise: list[tuple]) -> list[tuple]:
    kept = []
    for test, body in cases:
        if test[0] == "const":
            if test[1]:
                otherwise = body
                break
            continue
        kept.append((test, body))
    return [("if", kept, otherwise)] if kept else otherwise


# --- closures --------------------------------------------------------------------------------


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _expression(tree: tuple) -> Callable[[Scope], Any]:
    kind = tree[0]
    if kind == "const":
        return lambda _, v=tree[1]: v
    if kind == "name":
        return lambda scope, n=tree[1]: scope.get(n)
    if kind == "field":
        return lambda scope, n=tree[1], f=tree[2]: value.get(f) if isinstance(value := scope.get(n), dict) else None
    a = _expression(tree[1])
    if kind == "not":
        return lambda scope: not a(scope)
    if kind == "filter":
        f = FILTERS[tree[2]]
        return lambda scope: f(_text(a(scope)))
    b = _expression(tree[2])
    return {
        "or": lambda scope: a(scope) or b(scope),
        "and": lambda scope: a(scope) and b(scope),
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "in": lambda scope: _text(a(scope)) in _text(b(scope)),
        "+": lambda scope: _text(a(scope)) + _text(b(scope)),
    }[kind]


def _block(body: list[tuple]) -> Callable[[Scope, bool], Iterator[Chunk]]:
    steps = [_statement(s) for s in body]

    def run(scope: Scope, masked: bool) -> Iterator[Chunk]:
        for step in steps:
            yield from step(scope, masked)

    return run


def _statement(tree: tuple) -> Callable[[Scope, bool], Iterator[Chunk]]:
    kind = tree[0]
    if kind == "out":
        if tree[1][0] == "const":
            chunk = _text(tree[1][1])
            return lambda scope, masked: iter(((chunk, masked),))
        value = _expression(tree[1])
        return lambda scope, masked: iter(((_text(value(scope)), masked),))
    if kind == "mask":
        inner = _block(tree[1])
        return lambda scope, masked: inner(scope, True)
    if kind == "set":
        value, name = _expression(tree[2]), tree[1]

        def assign(scope: Scope, masked: bool) -> Iterator[Chunk]:
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "if":
        cases = [(_expression(test), _block(body)) for test, body in tree[1]]
        otherwise = _block(tree[2])

        def choose(scope: Scope, masked: bool) -> Iterator[Chunk]:
            return next((body for test, body in cases if test(scope)), otherwise)(scope, masked)

        return choose
    name, inner = tree[1], _block(tree[2])

    def loop(scope: Scope, masked: bool) -> Iterator[Chunk]:
        messages = iter(scope["messages"])
        message = next(messages, None)
        index = 0
        while message is not None:
            following = next(messages, None)
            index += 1
            scope[name] = message
            scope["loop"] = {"index": index, "index0": index - 1, "first": index == 1, "last": following is None}
            yield from inner(scope, masked)
            message = following

    return loop


@functools.lru_cache(maxsize=32)
def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[Chunk]]:
    """A function from messages (dicts of fields) to the rendered chunks and their mask."""
    body = _block(parse(template))
    return lambda messages: body({"messages": messages}, False)


TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
_START, _END = "<|im_start|>", "<|im_end|>\n"


def read_turn(chunk: str) -> tuple[str, str]:
    """Role and text of one rendered turn of ``TEMPLATE``."""
    if not (chunk.startswith(_START) and chunk.endswith(_END)):
        raise ValueError("not a rendered turn")
    role, _, text = chunk[len(_START) : -len(_END)].partition("\n")
    return unescape(role), unescape(text)


class _Digest:
    """Reads a conversation's output back as it streams by, turn by turn."""

    def __init__(self):
        self.turns = self.chars = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.pending: list[str] = []

    def add(self, chunks: Iterable[Chunk]) -> None:
        for text, masked in chunks:
            self.chars += len(text)
            self.pending.append(text)
            if masked:
                plain = unescape(text)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode("utf-8", "surrogatepass"))
            if text.endswith(_END):  # texts are escaped, so a control string is the template's own
                for turn in "".join(self.pending).split(_START)[1:]:
                    role, said = read_turn(_START + turn)
                    self.all.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    self.turns += 1
                self.pending = []

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conversation, its messages) from rows sorted by conversation; messages are read lazily."""
    rows = ((c, {"role": r or "", "text": t or ""}) for b in batches for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    held = next(rows, None)
    while held is not None:
        conv = held[0]

        def messages(conv=conv):
            nonlocal held
            while held is not None and held[0] == conv:
                message = held[1]
                held = next(rows, None)
                yield message

        stream = messages()
        yield conv, stream
        for _ in stream:  # whatever a template left unread
            pass


def _sorted_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = conversations.select(F.col(conv_col).cast("bigint").alias("c"), F.col(role_col).cast("string").alias("r"), F.col(text_col).cast("string").alias("t"), F.col(turn_col).cast("bigint").alias("n"))
    return rows.repartition("c").sortWithinPartitions("c", F.col("n").asc_nulls_first(), "r", "t").select("c", "r", "t")


def _digest_partition(batches: Iterator[pa.RecordBatch], template: str) -> Iterator[pa.RecordBatch]:
    render = compile_template(template)
    out: list[tuple] = []
    for conv, messages in _conversations(batches):
        digest = _Digest()
        digest.add(render(messages))
        out.append(digest.row(conv))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _DIGEST_TYPES, strict=True)], [f.split()[0] for f in _DIGESTS.split(", ")])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _DIGEST_TYPES, strict=True)], [f.split()[0] for f in _DIGESTS.split(", ")])


def digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """What each conversation's output says when it is read back, in one streaming pass.

    A conversation's digest needs its turns in order, so they meet in one task; rows arrive sorted (and
    spill as needed) and stream through the template, so memory holds one turn, not one conversation.
    Turns go by ``turn`` (nulls first), ties by role and text. Null texts and roles count as empty, rows
    without a conversation are one conversation. An empty table gives an empty result.
    """
    rows = _sorted_rows(conversations, conv_col, turn_col, role_col, text_col)
    return rows.mapInArrow(lean(lambda b: _digest_partition(b, template)), _DIGESTS)


def _format_partition(batches: Iterator[pa.RecordBatch], template: str) -> Iterator[pa.RecordBatch]:
    render = compile_template(template)
    for conv, messages in _conversations(batches):
        parts, spans, at = [], [], 0
        for text, masked in render(messages):
            if masked and text:
                if spans and spans[-1]["to"] == at:
                    spans[-1]["to"] = at + len(text)
                else:
                    spans.append({"from": at, "to": at + len(text)})
            parts.append(text)
            at += len(text)
        span_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(parts)]), pa.array([spans], span_type)], ["conv_id", "formatted", "loss_spans"])


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """``conv_id``, ``formatted`` text and ``loss_spans`` (code point ranges under the loss mask).

    A conversation is one row, so its text is held whole; ``digests`` is not bound to that. Order, ties, null texts, roles and
    conversations, repeated rows and empty tables are as there; extra columns are ignored.
    """
    rows = _sorted_rows(conversations, conv_col, turn_col, role_col, text_col)
    return rows.mapInArrow(lean(lambda b: _format_partition(b, template)), "conv_id bigint, formatted string, loss_spans array<struct<`from`: bigint, `to`: bigint>>")
