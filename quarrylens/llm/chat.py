"""Chat formatting with compiled templates.

The template language is small and has no way out of its sandbox: no calls, no attributes but the ones listed, no imports.

=============================================  ====================================================================
``{{ expression }}``                           writes a value
``{% for turn in turns %} … {% endfor %}``     repeats for the turns in order
``{% if expression %} … {% else %} … {% endif %}``  chooses
``{% generation %} … {% endgeneration %}``     marks what the model is trained on
``turn.role  turn.text  loop.first  loop.last``  the values
``'literal'  ==  !=  and  or  not  ~  ( )``    literals, comparison, logic, joining
``value | escape``                             hides control strings, reversibly; also ``upper lower trim``
=============================================  ====================================================================

A template is parsed into a tree of tuples, constants are folded (joined literals, decided branches, neighbouring text)
and each node becomes a Python closure.  Rendering gives the text and the spans between generation markers.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns between marks; texts and roles are escaped, assistant texts are generation spans.
TEMPLATE = (
    "{% for turn in turns %}{{ '<turn' ~ ' role=' }}{{ turn.role | escape }}>\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}</turn>\n{% endfor %}")

#: Characters from which a conversation goes on in another piece.
PIECE = 4_000_000
#: Every control string of the template holds one of these characters; the escaped texts hold neither.
_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_UNESCAPES = {v: k for k, v in _ESCAPES.items()}
_ESCAPED = re.compile(r"[\\<>]")
_MARK = re.compile(r"\\[\\lg]")
_TURN = re.compile(r"<turn role=([^<>]*)>\n([^<>]*)</turn>\n")
_PIECE = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_][A-Za-z_.]*)|(==|!=|[~|()]))")
_VALUES = ("turn.role", "turn.text", "loop.first", "loop.last")


class TemplateError(ValueError):
    """The template uses something that the language does not have."""


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: _UNESCAPES[m[0]], text)


_FILTERS = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class _Expression:
    """Recursive descent over the tokens of one expression; nodes are ``(kind, ...)``."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append(("literal", m[1]) if m[1] is not None else ("word", m[2]) if m[2] else ("sign", m[3]))
            at = m.end()

    def parse(self):
        node = self._either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return node

    def _take(self, *wanted) -> str | None:
        if self.tokens and self.tokens[0][0] != "literal" and self.tokens[0][1] in wanted:
            return self.tokens.pop(0)[1]
        return None

    def _either(self):
        node = self._both()
        while self._take("or"):
            node = ("or", node, self._both())
        return node

    def _both(self):
        node = self._negated()
        while self._take("and"):
            node = ("and", node, self._negated())
        return node

    def _negated(self):
        return ("not", self._negated()) if self._take("not") else self._compared()

    def _compared(self):
        node = self._joined()
        if sign := self._take("==", "!="):
            node = (sign, node, self._joined())
        return node

    def _joined(self):
        node = self._filtered()
        while self._take("~"):
            node = ("~", node, self._filtered())
        return node

    def _filtered(self):
        node = self._atom()
        while self._take("|"):
            name = self.tokens.pop(0)[1] if self.tokens else ""
            if name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def _atom(self):
        if self._take("("):
            node = self._either()
            if not self._take(")"):
                raise TemplateError("missing )")
            return node
        kind, text = self.tokens.pop(0) if self.tokens else ("end", "nothing")
        if kind == "literal":
            return ("value", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "word" and text in _VALUES:
            return ("name", text)
        raise TemplateError(f"no value {text!r}")


def parse(template: str) -> tuple:
    """The syntax tree: ``("block", [nodes])`` of ``text``, ``out``, ``if``, ``for`` and ``generation`` nodes."""
    stack = [("block", None, [], None)]
    for piece in _PIECE.split(template):
        if piece.startswith("{{"):
            stack[-1][2].append(("out", _Expression(piece[2:-2]).parse()))
        elif not piece.startswith("{%"):
            if piece:
                stack[-1][2].append(("text", piece))
        else:
            body = piece[2:-2].strip()
            word = body.split(None, 1)[0] if body else ""
            if word == "for":
                if body.split() != ["for", "turn", "in", "turns"]:
                    raise TemplateError("the only loop is: for turn in turns")
                stack.append(("for", None, [], None))
            elif word == "if":
                stack.append(("if", _Expression(body[2:]).parse(), [], None))
            elif word == "generation":
                stack.append(("generation", None, [], None))
            elif word == "else" and stack[-1][0] == "if" and stack[-1][3] is None:
                kind, test, nodes, _ = stack.pop()
                stack.append((kind, test, [], nodes))
            elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
                kind, test, nodes, before = stack.pop()
                block = ("block", nodes)
                node = (kind, block) if kind != "if" else (
                    ("if", test, ("block", before), block) if before is not None else ("if", test, block, ("block", [])))
                stack[-1][2].append(node)
            else:
                raise TemplateError(f"unexpected {body!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return ("block", stack[0][2])


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value)


def fold(node: tuple) -> tuple:
    """The tree with constant expressions evaluated, decided branches taken and neighbouring texts joined."""
    kind = node[0]
    if kind in ("value", "name", "text"):
        return node
    if kind == "filter":
        inner = fold(node[2])
        return ("value", _FILTERS[node[1]](_text(inner[1]))) if inner[0] == "value" else ("filter", node[1], inner)
    if kind == "not":
        inner = fold(node[1])
        return ("value", not inner[1]) if inner[0] == "value" else ("not", inner)
    if kind in ("~", "==", "!=", "and", "or"):
        a, b = fold(node[1]), fold(node[2])
        return ("value", _BINARY[kind](a[1], b[1])) if a[0] == b[0] == "value" else (kind, a, b)
    if kind == "out":
        inner = fold(node[1])
        return ("text", _text(inner[1])) if inner[0] == "value" else ("out", inner)
    if kind == "if":
        test, then, other = fold(node[1]), fold(node[2]), fold(node[3])
        return (then if test[1] else other) if test[0] == "value" else ("if", test, then, other)
    if kind in ("for", "generation"):
        return (kind, fold(node[1]))
    nodes = []
    for child in map(fold, node[1]):
        for part in child[1] if child[0] == "block" else [child]:
            if part[0] == "text" and nodes and nodes[-1][0] == "text":
                nodes[-1] = ("text", nodes[-1][1] + part[1])
            elif part != ("text", ""):
                nodes.append(part)
    return ("block", nodes)


_BINARY = {"~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
           "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def _value(node: tuple):
    """A closure ``scope -> value`` of an expression."""
    kind = node[0]
    if kind == "value":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope[n]
    if kind == "filter":
        return lambda scope, f=_FILTERS[node[1]], inner=_value(node[2]): f(_text(inner(scope)))
    if kind == "not":
        return lambda scope, inner=_value(node[1]): not inner(scope)
    return lambda scope, f=_BINARY[kind], a=_value(node[1]), b=_value(node[2]): f(a(scope), b(scope))


class _Output:
    def __init__(self):
        self.parts, self.length, self.marked = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _writer(node: tuple):
    """A closure ``(scope, turns, output) -> None`` of a statement."""
    kind = node[0]
    if kind == "text":
        return lambda scope, turns, out, t=node[1]: out.write(t)
    if kind == "out":
        return lambda scope, turns, out, v=_value(node[1]): out.write(_text(v(scope)))
    if kind == "if":
        return lambda scope, turns, out, test=_value(node[1]), a=_writer(node[2]), b=_writer(node[3]): (
            a if test(scope) else b)(scope, turns, out)
    if kind == "for":
        def repeat(scope, turns, out, body=_writer(node[1])):
            for i, (role, text) in enumerate(turns):
                body({"turn.role": role, "turn.text": text, "loop.first": i == 0, "loop.last": i == len(turns) - 1},
                     turns, out)
        return repeat
    if kind == "generation":
        def marked(scope, turns, out, body=_writer(node[1])):
            start = out.length
            body(scope, turns, out)
            out.marked.append((start, out.length))
        return marked

    def block(scope, turns, out, parts=tuple(map(_writer, node[1]))):
        for part in parts:
            part(scope, turns, out)
    return block


@lru_cache(maxsize=8)
def compiled(template: str):
    """``turns -> (text, spans)`` of a template; ``turns`` is a list of (role, text)."""
    write = _writer(fold(parse(template)))
    nothing = dict.fromkeys(_VALUES)

    def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write(nothing, turns, out)
        return "".join(out.parts), out.marked

    return render


def _loops(node) -> int:
    """Loops of a tree."""
    return (node[:1] == ("for",)) + sum(_loops(x) for x in node if isinstance(x, (tuple, list))) if node else 0


@lru_cache(maxsize=8)
def compiled_turn(template: str):
    """``(role, text, first, last) -> (text, spans)`` of one turn, for templates that are one loop over the turns."""
    tree = fold(parse(template))
    if len(tree[1]) != 1 or tree[1][0][0] != "for" or _loops(tree) != 1:
        raise TemplateError("pieces need a template that is one loop over the turns")
    write = _writer(tree[1][0][1])

    def render(role: str, text: str, first: bool, last: bool) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write({"turn.role": role, "turn.text": text, "loop.first": first, "loop.last": last}, [], out)
        return "".join(out.parts), out.marked

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a text made with :data:`TEMPLATE`."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _ordered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The turns of each conversation one after the other, in order."""
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted_pieces(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text", most: int = PIECE) -> DataFrame:
    """Conversations as pieces of whole turns: ``conv_id, piece, start, formatted, spans``.

    Pieces are numbered from 0 and come in order; a new one begins at ``most`` characters.  ``start`` and the spans count
    code points of the whole conversation.  A task holds one piece and one turn, however long the conversation is.
    Order, nulls and repeated rows are those of :func:`formatted_conversations`.
    """
    compiled_turn(template)
    ordered = _ordered(turns, id_col, turn_col, role_col, text_col)

    def work(stream):
        render, kind = compiled_turn(template), None
        mark = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        rows, waiting = [], 0  # finished pieces, their characters
        number, start, at, parts, spans = 0, 0, 0, [], []  # of the current piece

        def batch_of():
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in r[4]] for r in rows], mark)],
                names=["conv_id", "piece", "start", "formatted", "spans"])

        held = None  # the turn before, which may be the last of its conversation
        first = True
        for source in (stream, [None]):
            for part in source:
                turns_ = [None] if part is None else zip(*(part.column(i).to_pylist() for i in (0, 2, 3)))
                kind = kind if part is None else part.column(0).type
                for turn in turns_:
                    if held is not None:
                        last = turn is None or turn[0] != held[0]
                        made, own = render(held[1], held[2], first, last)
                        parts.append(made)
                        spans += [(at + a, at + b) for a, b in own]
                        at += len(made)
                        first = last
                        if last or at - start >= most:
                            rows.append((held[0], number, start, "".join(parts), spans))
                            waiting += at - start
                            number, start, parts, spans = number + 1, at, [], []
                            if last:
                                number = start = at = 0
                        if waiting >= most or len(rows) >= 10_000:
                            yield batch_of()
                            rows, waiting = [], 0
                    held = turn
        if rows:
            yield batch_of()

    kind = dict(ordered.dtypes)["conv_id"]
    return ordered.mapInArrow(work, f"conv_id {kind}, piece bigint, start bigint, formatted string, "
                                    "spans array<struct<start: bigint, end: bigint>>")


def formatted_conversations(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn",
                            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, spans`` (start and end of what is trained on, in code points).

    Turns are ordered by number (null first), then role and text; repeated rows stay.  A null role or text counts as empty;
    rows with a null id are one conversation.  The formatted text is one string of the result, so a conversation must fit
    one; :func:`formatted_pieces` has no such bound.  An empty table gives no rows; other columns are ignored.
    """
    compiled(template)
    ordered = _ordered(turns, id_col, turn_col, role_col, text_col)

    def work(stream):
        render, kind = compiled(template), None
        mark = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def batch_of(done):
            made = [render(t) for _, t in done]
            return pa.RecordBatch.from_arrays([
                pa.array([c for c, _ in done], kind), pa.array([f for f, _ in made], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], mark)],
                names=["conv_id", "formatted", "spans"])

        done, chars, last = [], 0, None
        for batch in stream:
            kind = batch.column(0).type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if last is None or last[0] != conv:
                    if chars > 4_000_000:
                        yield batch_of(done)
                        done, chars = [], 0
                    last = (conv, [])
                    done.append(last)
                last[1].append((role, text))
                chars += len(text)
        if done:
            yield batch_of(done)

    kind = dict(ordered.dtypes)["conv_id"]
    return ordered.mapInArrow(work, f"conv_id {kind}, formatted string, spans array<struct<start: bigint, end: bigint>>")


def chat_report(turns: DataFrame, most: int = PIECE, **columns) -> DataFrame:
    """Per conversation, read back from the formatted text: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``.

    The digests are fed piece by piece, so no conversation is ever in memory as a whole.
    """
    made = formatted_pieces(turns, most=most, **columns)

    def work(stream):
        done, kind, conv, state = [], None, None, None

        def close():
            n, said, loss, n_loss, chars = state
            done.append((conv, n, said.hexdigest(), n_loss, loss.hexdigest(), chars))

        def batch_of():
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in stream:
            kind = batch.column(0).type
            for own, number, start, text, spans in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if number == 0:
                    if state is not None:
                        close()
                    conv, state = own, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    part = unescape(text[s["start"] - start:s["end"] - start])
                    state[2].update(part.encode())
                    state[3] += len(part)
                state[4] += len(text)
            if len(done) >= 10_000:
                yield batch_of()
                done = []
        if state is not None:
            close()
            yield batch_of()

    kind = dict(made.dtypes)["conv_id"]
    return made.mapInArrow(work, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                 "loss_sha256 string, formatted_chars bigint")
