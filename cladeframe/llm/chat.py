"""Chat formatting: a small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}   {% set name = e %}
    {% for name in e %} {% endfor %}   {% generation %} {% endgeneration %}   {# comment #}

Expressions have strings, integers, true, false, none, names, a.b and a['b'] on mappings, comparison,
in, and, or, not, +, - and ~ (text joined), and filters after |. There are no calls, and nothing of
Python's objects can be reached. A name that is not given is none: it prints as nothing, has length 0
and holds nothing; where an operation has no meaning for its values, TemplateError is raised. What
stands between the generation markers is noted as loss spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns of one conversation that go into one row of output; the rendering of longer ones goes on in the next row.
SEGMENT_TURNS = 4096


class TemplateError(ValueError):
    """The template cannot be parsed, or asks for something the sandbox has not."""


def escape(text: str) -> str:
    """text with a backslash before each backslash, #, < and :, so that no control string is left in it."""
    return re.sub(r"([\\#<:])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "capitalize": lambda v: _text(v).capitalize(),
    "length": lambda v: 0 if v is None else len(v),
}


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"cannot print a {type(value).__name__}")


# --- syntax tree -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """A pure operation on expressions."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Print:
    value: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    cases: tuple
    otherwise: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: b is not None and a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: _text(a) + _text(b),
    "not": lambda a: not a,
} | {f"|{name}": f for name, f in FILTERS.items()}

_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+\-~|.()\[\]=]))", re.S
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one tag."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[0][1] if self.tokens and self.tokens[0][0] != "str" else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if not self.tokens or wanted is not None and self.peek() != wanted:
            raise TemplateError(f"expected {wanted or 'more'} before {self.tokens[:1]}")
        return self.tokens.pop(0)

    def name(self) -> str:
        kind, value = self.take()
        if kind != "name":
            raise TemplateError(f"expected a name, not {value!r}")
        return value

    def whole(self):
        value = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return value

    def _chain(self, ops: tuple[str, ...], below: Callable):
        left = below()
        while self.peek() in ops:
            left = Apply(self.take()[1], (left, below()))
        return left

    def either(self):
        return self._chain(("or",), self.both)

    def both(self):
        return self._chain(("and",), self.negated)

    def negated(self):
        if self.peek() == "not":
            self.take()
            return Apply("not", (self.negated(),))
        return self._chain(("==", "!=", "<", "<=", ">", ">=", "in"), self.sum)

    def sum(self):
        return self._chain(("+", "-", "~"), self.filtered)

    def filtered(self):
        value = self.member()
        while self.peek() == "|":
            self.take()
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            value = Apply(f"|{name}", (value,))
        return value

    def member(self):
        value = self.atom()
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                value = Item(value, Const(self.name()))
            else:
                value = Item(value, self.either())
                self.take("]")
        return value

    def atom(self):
        kind, value = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if value == "(":
            inner = self.either()
            self.take(")")
            return inner
        if kind == "name":
            words = {"true": True, "false": False, "none": None}
            return Const(words[value]) if value in words else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = _TAGS.split(source)
    at = 0

    def body(ends: tuple[str, ...]) -> tuple[tuple, str, str]:
        nonlocal at
        nodes: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(Print(_Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(nodes), word, rest
                nodes.append(statement(word, rest))
            elif part and not part.startswith("{#"):
                nodes.append(Print(Const(part)))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(nodes), "", ""

    def statement(word: str, rest: str):
        if word == "set":
            e = _Expression(rest)
            name = e.name()
            e.take("=")
            return Assign(name, e.whole())
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.take("in")
            over = e.whole()
            return For(name, over, body(("endfor",))[0])
        if word == "generation":
            return Generation(body(("endgeneration",))[0])
        if word == "if":
            cases, otherwise = [], ()
            test = _Expression(rest).whole()
            while True:
                inner, end, more = body(("elif", "else", "endif"))
                cases.append((test, inner))
                if end == "elif":
                    test = _Expression(more).whole()
                    continue
                if end == "else":
                    otherwise = body(("endif",))[0]
                return If(tuple(cases), otherwise)
        raise TemplateError(f"there is no statement {word!r}")

    return body(())[0]


def fold(node):
    """The tree with constant parts worked out, dead branches gone and neighbouring text joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if out and all(isinstance(z, Print) and isinstance(z.value, Const) for z in (out[-1], y)):
                    out[-1] = Print(Const(_text(out[-1].value.value) + _text(y.value.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(fold(a) for a in node.args)
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op in OPERATIONS and all(isinstance(a, Const) for a in args):
            try:
                return Const(OPERATIONS[node.op](*(a.value for a in args)))
            except TypeError as e:
                raise TemplateError(str(e)) from e
        return Apply(node.op, args)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Print):
        return Print(fold(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        cases, otherwise = [], fold(node.otherwise)
        for test, inner in node.cases:
            test = fold(test)
            if isinstance(test, Const):
                if test.value:
                    otherwise = fold(inner)
                    break
            else:
                cases.append((test, fold(inner)))
        return If(tuple(cases), otherwise) if cases else otherwise
    return node


@dataclass
class _Run:
    """What one rendering has come to: names, pieces of output, its length and the loss spans."""

    names: dict
    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)


def _value(node) -> Callable[[_Run], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda run: value
    if isinstance(node, Name):
        name = node.name
        return lambda run: run.names.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(run: _Run):
            holder, name = of(run), key(run)
            return holder.get(name) if type(holder) is dict and type(name) in (str, int, bool) else None

        return item
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda run: args[0](run) and args[1](run)
    if node.op == "or":
        return lambda run: args[0](run) or args[1](run)
    f = OPERATIONS[node.op]

    def applied(run: _Run):
        values = [a(run) for a in args]
        try:
            return f(*values)
        except TypeError as e:
            raise TemplateError(f"{node.op} cannot take {', '.join(type(v).__name__ for v in values)}") from e

    return applied


def _action(node) -> Callable[[_Run], None]:
    if isinstance(node, tuple):
        steps = [_action(x) for x in node]

        def sequence(run: _Run) -> None:
            for step in steps:
                step(run)

        return sequence
    if isinstance(node, Print):
        value = _value(node.value)

        def show(run: _Run) -> None:
            text = _text(value(run))
            run.pieces.append(text)
            run.length += len(text)

        return show
    if isinstance(node, Assign):
        given = _value(node.value)
        return lambda run: run.names.__setitem__(node.name, given(run))
    if isinstance(node, Generation):
        inner = _action(node.body)

        def marked(run: _Run) -> None:
            start = run.length
            inner(run)
            run.spans.append((start, run.length))

        return marked
    if isinstance(node, If):
        cases = [(_value(t), _action(b)) for t, b in node.cases]
        otherwise = _action(node.otherwise)

        def choose(run: _Run) -> None:
            for test, inner in cases:
                if test(run):
                    return inner(run)
            return otherwise(run)

        return choose
    over, body = _value(node.over), _action(node.body)

    def loop(run: _Run) -> None:
        rows = over(run)
        if type(rows) is not list:
            raise TemplateError("for needs a list")
        held = {k: run.names.get(k) for k in (node.name, "loop")}
        for i, row in enumerate(rows):
            _turn(run, node.name, row, i, i + 1 == len(rows))
            body(run)
        run.names.update(held)

    return loop


def _turn(run: _Run, name: str, row, i: int, last: bool) -> None:
    run.names[name] = row
    run.names["loop"] = {"index": i + 1, "first": i == 0, "last": last}


def _names(node) -> Iterator[str]:
    """The names that a part of a tree reads or sets."""
    if isinstance(node, tuple):
        for x in node:
            yield from _names(x)
    elif is_dataclass(node):
        if isinstance(node, (Name, Assign, For)):
            yield node.name
        for f in fields(node):
            yield from _names(getattr(node, f.name))


class Rendering:
    """A template's rendering of one conversation after another, turn by turn.

    Where the template names messages once only, as what a for at its top goes through, each turn is
    rendered as it comes, and take() gives what is there so far; what the template has set goes on.
    Any other template is rendered when the conversation ends.
    """

    def __init__(self, source: str, names: dict):
        self.given = names
        tree = fold(parse(source))
        at = [i for i, x in enumerate(tree) if isinstance(x, For) and x.over == Name("messages")]
        self.steady = len(at) == 1 and list(_names(tree)).count("messages") == 1
        if self.steady:
            self.name = tree[at[0]].name
            self.before, self.body, self.after = (_action(x) for x in (tree[: at[0]], tree[at[0]].body, tree[at[0] + 1 :]))
        else:
            self.all = _action(tree)

    def begin(self) -> None:
        self.run, self.n, self.messages = _Run(dict(self.given)), 0, []
        if self.steady:
            self.before(self.run)
            self.held = {k: self.run.names.get(k) for k in (self.name, "loop")}

    def turn(self, message: dict, last: bool) -> None:
        if self.steady:
            _turn(self.run, self.name, message, self.n, last)
            self.body(self.run)
        else:
            self.messages.append(message)
        self.n += 1

    def end(self) -> None:
        if self.steady:
            self.run.names.update(self.held)
            self.after(self.run)
        else:
            self.run.names["messages"] = self.messages
            self.all(self.run)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        """The text since the last time and its loss spans; the rendering goes on behind it."""
        out = "".join(self.run.pieces), self.run.spans
        self.run.pieces, self.run.spans, self.run.length = [], [], 0
        return out


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's names that gives the text and its loss spans, in code points."""
    action = _action(fold(parse(source)))

    def render(**names) -> tuple[str, list[tuple[int, int]]]:
        run = _Run(names)
        action(run)
        return "".join(run.pieces), run.spans

    return render


#: Marks each turn with its role; the assistant's texts bear the loss.
TURNS = (
    "{% for m in messages %}### {{ m.role | escape }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*+): ((?:\\.|[^\\<])*+)</turn>\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of what TURNS has rendered."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


_SEGMENT = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("segment", pa.int64()),
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_SEGMENT_DDL = "conv_id bigint, segment bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"


def _render(template: str, names: dict, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rendering = Rendering(template, names)
        now, waiting, segment, done = None, None, 0, []

        def give() -> None:
            nonlocal segment
            text, spans = rendering.take()
            done.append({"conv_id": now[0], "segment": segment, "formatted": text, "loss": [{"start": a, "end": b} for a, b in spans]})
            segment += 1

        def place(last: bool) -> None:
            if rendering.steady and rendering.n and rendering.n % most == 0:
                give()
            rendering.turn(waiting, last)
            if last:
                rendering.end()
                give()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for conv, role, text in zip(*columns):
                fresh = now is None or now[0] != conv
                if now is not None:
                    place(fresh)
                if fresh:
                    now, segment = (conv,), 0
                    rendering.begin()
                waiting = {"role": role or "", "text": text or ""}
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_SEGMENT)
                done.clear()
        if now is not None:
            place(True)
            yield pa.RecordBatch.from_pylist(done, schema=_SEGMENT)

    return run


def _plain(value) -> bool:
    if type(value) is list:
        return all(map(_plain, value))
    if type(value) is dict:
        return all(type(k) is str and _plain(v) for k, v in value.items())
    return value is None or type(value) in (str, int, bool)


def format_chats(
    turns: DataFrame,
    template: str = TURNS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment_turns: int = SEGMENT_TURNS,
    names: dict | None = None,
) -> DataFrame:
    """conv_id, segment, formatted and loss (spans of formatted in code points) of every conversation.

    Turns come in order of turn, then role and text; null role or text is empty, a null turn comes
    first, null conv_ids make one conversation, repeated rows are repeated turns; other columns are not
    read; an empty table gives an empty result. The template gets messages (role and text of each turn)
    and names, values of the caller's own made of strings, integers, booleans, none, lists and
    mappings, such as a text to begin with or whether to ask for an answer.

    One rendering goes through all turns of a conversation. After segment_turns turns what is rendered
    so far goes out as a row, so that a worker holds that many turns; the segments of a conversation,
    read one after another, are its text, whatever their size, and they stand together and in order.
    Templates that use messages otherwise than in one for at the top need the whole conversation at
    once and give one row. TemplateError is raised for a template or names that are not allowed.
    """
    names = names or {}
    if "messages" in names or not _plain(names):
        raise TemplateError("names must be plain values, and messages is taken")
    compile_template(template)
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_render(template, names, segment_turns), _SEGMENT_DDL)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state: list = []
    expected = 0

    def result() -> list:
        return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["segment"] == 0 and not (state and row["conv_id"] == state[0]):
                if state:
                    done.append(result())
                state[:] = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                expected = 0
            if not state or row["conv_id"] != state[0] or row["segment"] != expected:
                raise ValueError(f"segment {expected} of a conversation is missing or comes twice")
            expected += 1
            text = row["formatted"]
            for role, said in read_turns(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for span in row["loss"]:
                said = unescape(text[span["start"] : span["end"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        if done:
            yield _rows(done, names)
    if state:
        yield _rows([result()], names)


def _rows(done: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from what
    format_chats() gave with TURNS, in whatever order and files its segments come. A null conv_id is a
    conversation like others, turns may be empty, an empty table gives an empty result; text that TURNS
    cannot have made, a segment that is missing and one that comes twice raise ValueError. Other columns are not read."""
    ordered = formatted.select("conv_id", "segment", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(
        _digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
