r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: text </turn>`` and a newline. The grammar
of the output, in full:

    conversation = turn*
    turn         = "### " role ": " body " </turn>\n"
    role, body   = (plain | escape)*
    escape       = "\" and any one character, which stands for itself

A rendered turn is reparsed by a deterministic parser. If the recovered role
and text differ from the source, or the turn does not end where the parser
says, the characters that conflict are escaped, a step further each time
(control strings; then every control character), until they are identical.
The loss mask covers the bodies of assistant turns.

Turns are rendered one by one, so a conversation of any length needs no room
of its own: its turns carry their place in it and stream past in order.

Results for odd input: null roles and texts are empty; rows repeat as often
as they are given, ordered by turn (null first), then role, then text; a null
conv_id is a conversation of its own; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerecs.llm.common import shuffle_partitions

OPEN, BETWEEN, CLOSE, ESCAPE = "### ", ": ", " </turn>\n", "\\"
ASSISTANT = "assistant"
#: What is escaped at each step; the last step conflicts with nothing.
STEPS = (
    lambda s, _: s,
    lambda s, end: s.replace(ESCAPE, ESCAPE * 2).replace(end, ESCAPE + end),
    lambda s, end: "".join(ESCAPE + c if c in ESCAPE + OPEN + BETWEEN + CLOSE else c for c in s),
)


def render(role: str, text: str, step: int) -> tuple[str, int]:
    """A turn's rendering and where its body begins."""
    head = OPEN + STEPS[step](role, BETWEEN) + BETWEEN
    return head + STEPS[step](text, CLOSE) + CLOSE, len(head)


def _until(s: str, at: int, end: str) -> tuple[str, int]:
    """What stands before the first unescaped ``end``, unescaped, and where ``end`` begins."""
    out = []
    while True:
        stop, escape = s.find(end, at), s.find(ESCAPE, at)
        if stop < 0:
            raise ValueError(f"no {end!r} after {at}")
        if not 0 <= escape < stop:
            return "".join(out) + s[at:stop], stop
        if escape + 1 >= len(s):
            raise ValueError("nothing is escaped at the end")
        out += [s[at:escape], s[escape + 1]]
        at = escape + 2


def parse(s: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """(role, text, body begin, body end, turn end) of the turn at ``at``."""
    if not s.startswith(OPEN, at):
        raise ValueError(f"no turn at {at}")
    role, at = _until(s, at + len(OPEN), BETWEEN)
    begin = at + len(BETWEEN)
    text, end = _until(s, begin, CLOSE)
    return role, text, begin, end, end + len(CLOSE)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The first rendering that parses back: (turn, body begin, body end)."""
    for step in range(len(STEPS)):
        turn, _ = render(role, text, step)
        try:
            found = parse(turn)
        except ValueError:
            continue
        if found[:2] == (role, text) and found[4] == len(turn):
            return turn, found[2], found[3]
    raise AssertionError("the last step escapes every conflict")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, start, loss_start, loss_end) per turn, in order
    within a partition that holds the whole conversation: the rendered turn,
    where it begins in the conversation, and the masked span there (null for
    turns without loss), in code points. A conversation's output is its
    turns' ``formatted`` one after the other."""
    n = shuffle_partitions(conversations.sparkSession)
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start = object(), 0
        for batch in batches:
            out = []
            for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != current:
                    current, start = conv_id, 0
                turn, begin, end = format_turn(role, text)
                loss = (start + begin, start + end) if role == ASSISTANT else (None, None)
                out.append((conv_id, turn, start, *loss))
                start += len(turn)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            names = ["conv_id", "formatted", "start", "loss_start", "loss_end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return turns.mapInArrow(formatted, "conv_id bigint, formatted string, start bigint, loss_start bigint, loss_end bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses the output of ``format_conversations`` (as it is dealt): per
    conversation the digests of its recovered turns and of the text under the
    loss mask. Only running digests are held, whatever a conversation's length."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def done() -> pa.RecordBatch:
            turns, turn_digest, loss, loss_digest, size = state
            row = [[current], [turns], [turn_digest.hexdigest()], [loss], [loss_digest.hexdigest()], [size]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for conv_id, turn, start, loss_start, loss_end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv_id != current:
                    if state is not None:
                        rows.append(done())
                    current, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(turn):
                    role, text, begin, end, at = parse(turn, at)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if loss_start is not None and loss_start <= start + begin and start + end <= loss_end:
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] = start + len(turn)
            if rows:
                yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        if state is not None:
            yield done()

    return formatted.mapInArrow(
        parsed,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
