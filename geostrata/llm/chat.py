"""Chat formatting by incremental black-box rendering.

The template is a function from a list of turns to a string, of which nothing else is assumed. Successive prefixes of the turns
are rendered and consecutive outputs compared: what a longer prefix appends is the span of its last turn, and an output that
does not begin with the one before it shows a template that rewrites history. A turn's text is located in its span by rendering
the turn once more with a probe in the text's place and comparing the two.

Prefixes are rendered whole, so the work of a conversation grows with the square of its turns: nothing less shows whether a
template of which nothing is known rewrites a turn far back. For a template that is said to look back less, a ``window`` of turns
bounds the prefixes, and the work grows with the number of turns. That it does is checked: at every doubling of the turns, and at the
end, the whole prefix is rendered and compared with the joined pieces, and where they differ the conversation is done again with
full prefixes. Turns arrive sorted in a stream per conversation, one of which a task holds in memory at a time, as the rendering of
it all has to be one string; the formatted text leaves as one row per turn.

Defined results: a null text or role counts as empty; turns are ordered by turn, then role and text, null turns first; a null
conversation id is a conversation of its own. Rows repeated are turns repeated. Empty tables give empty results. Other columns
of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import only

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: The role whose texts are trained on.
TRAINED = "assistant"
#: Turns that standard() is rendered with: it looks at one turn at a time.
STANDARD_WINDOW = 2

_CONTROL = re.compile(r"[\\<>#:]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Puts a backslash before every character that the template's own marks are made of, and before backslashes."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def standard(turns: list[Turn]) -> str:
    """The template: ``<turn>### role: text</turn>`` and a line feed for every turn, roles and texts escaped."""
    return "".join(f"<turn>### {escape(role)}: {escape(text)}</turn>\n" for role, text in turns)


def rewriting(turns: list[Turn]) -> str:
    """A template that drops all but the last system turn: a longer prefix changes what was rendered before. Used in tests."""
    last = max((i for i, t in enumerate(turns) if t[0] == "system"), default=-1)
    return standard([t for i, t in enumerate(turns) if t[0] != "system" or i == last])


def _common(a: str, b: str) -> int:
    """The length of the longest common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def text_span(render: Template, before: list[Turn], turn: Turn, whole: str) -> tuple[int, int]:
    """Where the text of ``turn`` stands in ``whole``, render(before + [turn]): what is left between the ends it shares with a probe."""
    if not turn[1]:
        at = _common(whole, render([*before, (turn[0], "x")]))
        return at, at
    # two probes that begin and end unlike one another keep the text's own ends from counting as the template's
    probes = [render([*before, (turn[0], probe)]) for probe in ("x", "y")]
    start = min(_common(whole, probe) for probe in probes)
    tail = min(_common(whole[::-1], probe[::-1]) for probe in probes)
    return start, len(whole) - min(tail, len(whole) - start)


def _prefixes(render: Template, turns, window: int | None):
    recent: list[Turn] = []
    before = ""  # what a template puts before all turns belongs to the first one's piece
    for turn in turns:
        after = render([*recent, turn])
        rewrites = not after.startswith(before)
        base = _common(before, after) if rewrites else len(before)
        start, end = text_span(render, recent, turn, after)
        yield after[base:], max(start - base, 0), max(end - base, 0), rewrites
        recent.append(turn)
        before = after
        if window and len(recent) >= window:
            recent = recent[len(recent) - window + 1 :]
            before = render(recent)


def pieces(render: Template, turns, window: int | None = None):
    """For each turn of one conversation: the text it appends, where its own text stands in that, and whether history changed.

    ``window``: turns of a prefix that are rendered, all by default or where the window turns out too small.
    """
    if not window:
        yield from _prefixes(render, turns, None)
        return
    turns = list(turns)
    out: list[tuple[str, int, int, bool]] = []
    for n, piece in enumerate(_prefixes(render, turns, window), 1):
        out.append(piece)
        if (n & (n - 1) == 0 or n == len(turns)) and "".join(p[0] for p in out) != render(turns[:n]):
            yield from _prefixes(render, turns, None)
            return
    yield from out


_PIECES = "conv long, seq long, piece string, text_start long, text_end long, trained boolean, rewrites boolean"


def _conversations(batches):
    """(conversation, iterator of its turns) of a stream that is sorted by conversation."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

    stream = rows()
    head = [next(stream, None)]

    def of(conv):
        while head[0] is not None and head[0][0] == conv:
            yield head[0]
            head[0] = next(stream, None)

    while head[0] is not None:
        conv = head[0][0]
        yield conv, (group := of(conv))
        for _ in group:
            pass


def _batches(rows, types, names, most: int = 2000, most_chars: int = 8 << 20):
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(out) >= most or size >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)


def format_chat(df: DataFrame, render: Template = standard, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", window: int | None = None) -> DataFrame:
    """``window``: for a template that looks back no further than so many turns (see pieces()).

    One row per turn: conv, seq, piece (the formatted text it appends), text_start and text_end (its own text in the piece, code
    points), trained (whether that text is under the loss mask) and rewrites. A conversation's pieces joined by seq are its text;
    they come from one partition, in order.
    """

    def run(batches):
        def rows():
            for conv, group in _conversations(batches):
                turns = ((role or "", text or "") for _, _, role, text in group)
                roles: list[str] = []

                def noted():
                    for t in turns:
                        roles.append(t[0])
                        yield t

                for seq, (piece, start, end, rewrites) in enumerate(pieces(render, noted(), window)):
                    yield conv, seq, piece, start, end, roles.pop(0) == TRAINED, rewrites

        yield from _batches(rows(), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()], ["conv", "seq", "piece", "text_start", "text_end", "trained", "rewrites"])

    turns = only(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col).select(F.col("conv").cast("long"), F.col("turn").cast("long"), "role", "text")
    return turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(run, _PIECES)


_TURN = re.compile(r"<turn>### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)


def parse(piece: str) -> list[Turn]:
    """The turns of a text of the standard template. Anything else in the text is an error."""
    out, at = [], 0
    while at < len(piece):
        if not (m := _TURN.match(piece, at)):
            raise ValueError(f"not a turn: {piece[at : at + 80]!r}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, taken from the formatted text alone: one pass over each partition of format_chat()'s result."""

    def run(batches):
        def rows():
            for conv, group in _conversations(batches):
                turns, loss, n, chars, length, rewrote = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False
                for _, _, piece, start, end, trained, rewrites in group:
                    for role, text in parse(piece):
                        turns.update(f"{role}\n{text}\n".encode())
                        n += 1
                    if trained:
                        masked = unescape(piece[start:end])
                        loss.update(masked.encode())
                        chars += len(masked)
                    length += len(piece)
                    rewrote |= rewrites
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), length, rewrote

        yield from _batches(rows(), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
