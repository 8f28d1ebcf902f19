"""Chat formatting: templates in a small sandboxed language, compiled to closures.

    {{ m.text|escape }}   {% for m in messages %} … {% endfor %}   {% if a == 'b' and not c %} … {% elif … %} … {% else %} …
    {% endif %}   {% generation %} … {% endgeneration %}

A template is parsed into a syntax tree, constant parts of the tree are folded, and the rest becomes closures. There is no
access to Python: a name is looked up among the template's variables, a dot among the keys of a mapping; nothing is called
but the filters below. What stands inside a generation block is marked for the loss.

Conversations are rendered turn by turn as their rows stream by, so one of any length needs the memory of one part.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template of the query. Its control strings mark turns; inside roles and texts they are escaped.
CONTROLS = ("<turn>", "<text>", "</turn>")
TEMPLATE = (
    "{% for m in messages %}<turn>{{ m.role|escape }}<text>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "</turn>{{ '\\n' }}{% endfor %}"
)
# A conversation goes on in a further part once a part has so many characters; parts end behind a turn.
PART_CHARS = 1 << 20

_PIECES = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~().|]))""", re.S)


class TemplateError(ValueError):
    pass


def escaper(controls: Iterable[str]) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """Escape and its inverse: a backslash before backslashes and before the first character of a control string."""
    marks = sorted(controls, key=len, reverse=True)
    found = re.compile("|".join([r"\\", *(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in marks)]))
    return lambda text: found.sub(lambda m: "\\" + m[0], text), lambda text: re.sub(r"\\(.)", r"\1", text, flags=re.S)


# --- parsing ---------------------------------------------------------------------------------------
# Expressions: ("const", v) ("name", n) ("key", e, n) ("not", e) ("and"|"or"|"=="|…|"+", a, b) ("filter", n, e)
# Statements:  ("text", s) ("show", e) ("for", name, e, body) ("if", e, then, otherwise) ("generation", body)


class _Expression:
    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        while source[at:].strip():
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.joined()
        while op := self.take("==", "!=", "<", ">", "<=", ">="):
            tree = (op, tree, self.joined())
        return tree

    def joined(self):
        tree = self.filtered()
        while op := self.take("+", "~"):
            tree = (op, tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.atom()
        while op := self.take(".", "|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
            if kind != "name":
                raise TemplateError(f"a name has to follow {op!r} in {self.source!r}")
            self.at += 1
            tree = ("key", tree, name) if op == "." else ("filter", name, tree)
        return tree

    def atom(self):
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(f"a bracket isn't closed in {self.source!r}")
            return tree
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name" and value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        if kind == "name":
            return ("name", value)
        raise TemplateError(f"an expression is missing in {self.source!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    root: list[tuple] = []
    # Open blocks: keyword, its head, finished branches of an if, statements so far.
    open_blocks: list[list] = [["", None, [], root]]

    def close(keyword: str) -> None:
        kind, head, branches, body = open_blocks.pop()
        if kind != keyword:
            raise TemplateError(f"end of {keyword!r} without its start")
        if kind == "for":
            done = ("for", head[0], head[1], body)
        elif kind == "generation":
            done = ("generation", body)
        else:
            branches.append((head, body))
            otherwise: list[tuple] = branches.pop()[1] if branches[-1][0] is None else []
            for test, then in reversed(branches):
                otherwise = [("if", test, then, otherwise)]
            done = otherwise[0] if otherwise else ("text", "")
        open_blocks[-1][3].append(done)

    at = 0
    for m in _PIECES.finditer(source):
        body = open_blocks[-1][3]
        if m.start() > at:
            body.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("show", _Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            name, given, value = rest.partition(" in ")
            if not given or not name.strip().isidentifier():
                raise TemplateError(f"cannot read {m[0]!r}")
            open_blocks.append(["for", (name.strip(), _Expression(value).whole()), [], []])
        elif word == "if":
            open_blocks.append(["if", _Expression(rest).whole(), [], []])
        elif word in ("elif", "else") and open_blocks[-1][0] == "if" and open_blocks[-1][1] is not None:
            block = open_blocks[-1]
            block[2].append((block[1], block[3]))
            block[1], block[3] = (_Expression(rest).whole() if word == "elif" else None), []
        elif word == "generation":
            open_blocks.append(["generation", None, [], []])
        elif word in ("endfor", "endif", "endgeneration"):
            close(word[3:])
        else:
            raise TemplateError(f"cannot read {m[0]!r}")
    if len(open_blocks) > 1:
        raise TemplateError(f"{open_blocks[-1][0]!r} isn't closed")
    if source[at:]:
        root.append(("text", source[at:]))
    return root


# --- folding and compiling -------------------------------------------------------------------------


def _shown(value) -> str:
    return "" if value is None else str(value)


def _operations(controls: Iterable[str]) -> dict[str, Callable]:
    escape, _ = escaper(controls)
    return {
        "escape": lambda x: escape(_shown(x)), "trim": lambda x: _shown(x).strip(), "upper": lambda x: _shown(x).upper(),
        "lower": lambda x: _shown(x).lower(), "length": lambda x: len(x or ""),
        "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
        "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "~": lambda a, b: _shown(a) + _shown(b),
    }


def _fold_expression(tree: tuple, ops: dict[str, Callable]) -> tuple:
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "key":
        return ("key", _fold_expression(tree[1], ops), tree[2])
    if kind == "filter":
        if tree[1] not in ops or not tree[1].isidentifier():
            raise TemplateError(f"no filter {tree[1]!r}")
        inner = _fold_expression(tree[2], ops)
        return ("const", ops[tree[1]](inner[1])) if inner[0] == "const" else ("filter", tree[1], inner)
    parts = [_fold_expression(x, ops) for x in tree[1:]]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(x[0] == "const" for x in parts):
        return ("const", not parts[0][1]) if kind == "not" else ("const", ops[kind](parts[0][1], parts[1][1])) if kind in ops else (kind, *parts)
    return (kind, *parts)


def fold(body: list[tuple], ops: dict[str, Callable]) -> list[tuple]:
    """Constant expressions evaluated, decided branches resolved, neighbouring texts joined."""
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "show":
            tree = _fold_expression(node[1], ops)
            done = [("text", _shown(tree[1]))] if tree[0] == "const" else [("show", tree)]
        elif kind == "for":
            done = [("for", node[1], _fold_expression(node[2], ops), fold(node[3], ops))]
        elif kind == "if":
            test, then, otherwise = _fold_expression(node[1], ops), fold(node[2], ops), fold(node[3], ops)
            done = (then if test[1] else otherwise) if test[0] == "const" else [("if", test, then, otherwise)]
        elif kind == "generation":
            done = [("generation", fold(node[1], ops))]
        else:
            done = [node]
        for x in done:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def _value(tree: tuple, ops: dict[str, Callable]) -> Callable:
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env.get(n)
    if kind == "key":
        inner, key = _value(tree[1], ops), tree[2]
        return lambda env: x.get(key) if isinstance(x := inner(env), dict) else None
    if kind == "filter":
        apply, inner = ops[tree[1]], _value(tree[2], ops)
        return lambda env: apply(inner(env))
    a = _value(tree[1], ops)
    if kind == "not":
        return lambda env: not a(env)
    b = _value(tree[2], ops)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    apply = ops[kind]
    return lambda env: apply(a(env), b(env))


# A rendered piece: text, whether it lies in a generation block, whether a turn ends here.
Piece = tuple[str, bool, bool]


def _statements(body: list[tuple], ops: dict[str, Callable], marked: bool, depth: int) -> Callable[[dict], Iterator[Piece]]:
    steps = [_statement(x, ops, marked, depth) for x in body]

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def _statement(node: tuple, ops: dict[str, Callable], marked: bool, depth: int) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        return lambda env, piece=(node[1], marked, False): (piece,)
    if kind == "show":
        value = _value(node[1], ops)
        return lambda env: ((_shown(value(env)), marked, False),)
    if kind == "generation":
        return _statements(node[1], ops, True, depth)
    if kind == "if":
        test, then, otherwise = _value(node[1], ops), _statements(node[2], ops, marked, depth), _statements(node[3], ops, marked, depth)
        return lambda env: then(env) if test(env) else otherwise(env)
    name, items, inner = node[1], _value(node[2], ops), _statements(node[3], ops, marked, depth + 1)

    def loop(env: dict) -> Iterator[Piece]:
        for i, item in enumerate(items(env) or ()):
            yield from inner({**env, name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0}})
            if depth == 0:
                yield ("", False, True)

    return loop


def compile_template(source: str, controls: Iterable[str] = CONTROLS) -> Callable[[dict], Iterator[Piece]]:
    """A function from variables to the rendered pieces in order. Loops may run over iterators of any length."""
    ops = _operations(controls)
    return _statements(fold(parse(source), ops), ops, False, 0)


def parts(pieces: Iterator[Piece], most: int = PART_CHARS) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Text and marked spans (code points, end exclusive) of each part; at least one part, and each ends behind a turn."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    size, given = 0, False
    for text, marked, ends in pieces:
        if marked and text:
            if spans and spans[-1][1] == size:
                spans[-1] = (spans[-1][0], size + len(text))
            else:
                spans.append((size, size + len(text)))
        out.append(text)
        size += len(text)
        if ends and size >= most:
            yield "".join(out), spans
            out, spans, size, given = [], [], 0, True
    if size or not given:
        yield "".join(out), spans


# --- over tables -----------------------------------------------------------------------------------


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def format_conversations(rows: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """``conv_id, part, formatted, loss array<struct<start, end>>`` for rows ``conv_id, turn, role, text``.

    One row for a conversation, more only where it is longer than ``PART_CHARS``. Turns go by number, equal numbers by role
    and text; null roles and texts are empty, a null turn comes first, rows of null conv_id are one conversation; repeated
    rows are repeated turns. An empty table gives an empty table; other columns are ignored.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, controls)
        made: list[tuple] = []
        size = 0
        for conv_id, turns in itertools.groupby(_tuples(batches), key=lambda r: r[0]):
            messages = ({"role": role, "text": text, "turn": turn} for _, turn, role, text in turns)
            for k, (text, spans) in enumerate(parts(render({"messages": messages}), PART_CHARS)):
                made.append((conv_id, k, text, [{"start": a, "end": b} for a, b in spans]))
                size += len(text)
                if size >= PART_CHARS:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in made], schema)
                    made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in made], schema)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    return _ordered(turns, "conv_id", "turn", "role", "text").mapInArrow(
        run, "conv_id long, part int, formatted string, loss array<struct<start:bigint,end:bigint>>"
    )


def read_turns(formatted: str, controls: tuple[str, ...] = CONTROLS) -> list[tuple[str, str]]:
    """Roles and texts of a part: the inverse of the standard template."""
    start, middle, end = controls
    _, plain = escaper(controls)
    turns, at, role = [], 0, ""
    for m in re.finditer("|".join([r"\\.", *map(re.escape, controls)]), formatted, re.S):
        if m[0] == start:
            at = m.end()
        elif m[0] == middle:
            role, at = plain(formatted[at : m.start()]), m.end()
        elif m[0] == end:
            turns.append((role, plain(formatted[at : m.start()])))
    return turns


def read_back(formatted: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from the formatted parts alone."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, plain = escaper(controls)
        done: list[tuple] = []
        code = lambda s: s.encode("utf-8", "surrogatepass")
        for conv_id, own in itertools.groupby(_tuples(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = lost = chars = 0
            for _, _, text, spans in own:
                chars += len(text)
                for role, said in read_turns(text, controls):
                    n += 1
                    turns.update(code(f"{role}\n{said}\n"))
                for span in spans:
                    masked = plain(text[span["start"] : span["end"]])
                    lost += len(masked)
                    loss.update(code(masked))
            done.append((conv_id, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in done], schema)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in done], schema)

    return _ordered(formatted.select("conv_id", "part", "formatted", "loss"), "conv_id", "part").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
