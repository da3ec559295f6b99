"""Chat formatting by incremental rendering.

A template is a black box: a function from a list of turns to a string. Rendering the first k turns for k = 1, 2, ...
and comparing neighbouring outputs shows where each turn's span lies, without any knowledge of the template. Where an
output does not start with the one before it, the template has rewritten history: the turn's span then begins where the
two part, and the turn is marked. Where a turn's text stands in the output is found in the same way: the same turns are
rendered twice more with two other texts in place of the last, and what both outputs have in common before and behind
is the frame.

Conversations stream: rows are dealt out by conversation and sorted by turn; a task holds one conversation at a time. For
a black box every prefix must be rendered whole, so n turns take time in proportion to n squared. A template may declare
that it is local: that a turn's part of the output depends on the last `reach` turns before it only, and that nothing
before it ever changes. Such a template is rendered over these turns alone, in time in proportion to n, and only the
last turns are held. The declaration is tested at every turn: on the first PROBE turns of a conversation against the whole
prefix, and where it does not hold there, whole prefixes are rendered all the same; on later turns against a window of
more than twice the length, and a template that has kept to its declaration for PROBE turns and then breaks it is an
error, never a wrong span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

Turn = tuple[str, str]
#: Strings that have a meaning to the model and never appear inside an escaped text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN", "[/TURN]", "<<SYS>>", "<</SYS>>")
#: Turns on which the declaration of a local template is tested against whole prefixes.
PROBE = 16
#: Texts that differ in each character, to find the place of a text.
_PLACES = ("\ue010", "\ue011")


def escape(text: str) -> str:
    """Double backslashes and put one behind the first character of each control string."""
    text = text.replace("\\", "\\\\")
    for mark in CONTROL:
        text = text.replace(mark, mark[0] + "\\" + mark[1:])
    return text


def unescape(text: str) -> str:
    """A doubled backslash stands for itself, a single one only breaks a control string."""
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_name(role: str) -> str:
    """A role within its line: escaped like a text, and line feeds as \\n."""
    return escape(role).replace("\n", "\\n")


def unescape_name(name: str) -> str:
    return re.sub(r"\\(\\|n?)", lambda m: "\n" if m[1] == "n" else m[1], name)


@dataclass(frozen=True)
class Template:
    """render gives the whole string for some turns. reach declares a local template (see above); None, the default,
    declares nothing, and every prefix is rendered."""

    render: Callable[[Sequence[Turn]], str]
    reach: int | None = None


_MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<s><<SYS>> ", " <</SYS>>")}


def _frame(role: str) -> tuple[str, str]:
    return _MARKS.get(role) or (f"[TURN {escape_name(role)}\n", " [/TURN]")


def _render(turns: Sequence[Turn]) -> str:
    out = []
    for role, text in turns:
        head, tail = _frame(role)
        out.append(head + escape(text) + tail)
    return "".join(out)


def read_turn(span: str) -> Turn:
    """The role and text that INST_TEMPLATE has rendered to this span."""
    for role, (head, tail) in sorted(_MARKS.items(), key=lambda m: -len(m[1][0])):
        if span.startswith(head) and span.endswith(tail):
            return role, unescape(span[len(head) : len(span) - len(tail)])
    name, _, rest = span[len("[TURN ") :].partition("\n")
    return unescape_name(name), unescape(rest[: len(rest) - len(" [/TURN]")])


#: Each turn is rendered by itself, so its reach is 0.
INST_TEMPLATE = Template(_render, reach=0)


def _shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class Renderer:
    """One conversation, turn by turn."""

    def __init__(self, template: Template) -> None:
        self.render, self.reach = template.render, template.reach
        self.turns: list[Turn] = []
        self.before, self.n, self.offset = "", 0, 0  # offset: of `before` in the conversation's whole output

    def add(self, turn: Turn, find_text: bool) -> tuple[str, int, tuple[int, int] | None, bool]:
        """The turn's part of the output, where it starts, where its text is (if asked for, and if it stands there in one
        piece), and whether earlier output has changed."""
        if self.reach is not None and self.n >= PROBE:
            wide = self.turns[-2 * self.reach - 1 :]
            near = wide[len(wide) - min(self.reach, len(wide)) :]
            base, start = self.render(wide), self.render(near)
            farther, nearer = self.render([*wide, turn]), self.render([*near, turn])
            if not farther.startswith(base) or not nearer.startswith(start) or farther[len(base) :] != nearer[len(start) :]:
                raise ValueError(f"the template's output of turn {self.n} depends on more than {self.reach} turns before it")
            self.offset += len(self.before) - len(base)
            self.turns, self.before = wide, base
        after = self.render([*self.turns, turn])
        same = _shared_prefix(self.before, after)
        rewritten = same < len(self.before)
        if self.reach is not None and self.n < PROBE:
            near = self.turns[max(0, self.n - self.reach) :]
            if rewritten or self.render([*near, turn])[len(self.render(near)) :] != after[same:]:
                self.reach = None
        place = self._place(turn, after) if find_text else None
        if place:
            same = min(same, place[0])  # what was rewritten may share the first characters of the text
        self.turns.append(turn)
        self.before, self.n = after, self.n + 1
        start = self.offset + same
        return after[same:], start, place and (self.offset + place[0], self.offset + place[1]), rewritten

    def _place(self, turn: Turn, after: str) -> tuple[int, int] | None:
        one, two = (self.render([*self.turns, (turn[0], text)]) for text in _PLACES)
        head = _shared_prefix(one, two)
        tail = _shared_prefix(one[:head:-1], two[:head:-1])
        fits = len(one) == len(two) == head + 1 + tail and len(after) >= head + tail
        fits = fits and after[:head] == one[:head] and after[len(after) - tail :] == one[len(one) - tail :]
        return (head, len(after) - tail) if fits else None


def format_turns(conversations: DataFrame, template: Template = INST_TEMPLATE, loss_role: str = "assistant") -> DataFrame:
    """conv_id, ord, role, piece, start, end, loss_start, loss_end, rewrites_history: one row per turn, in order within
    its partition, all turns of a conversation in one partition.

    Each row says: cut the conversation's output at start, and append piece; end is its length then. For a template that
    never rewrites, that is joining the pieces, and start to end is the turn's span. rewrites_history marks the turns
    that cut away output of earlier turns; spans of earlier turns that reach beyond such a start hold no longer.
    loss_start and loss_end (null for other roles) are where the text stands under the loss mask, null too if the
    template does not show the text in one piece. All numbers are code points.

    Rows are taken by turn, then role, then text, nulls first; repeated rows are turns of their own. A null text or role
    is empty; a null conv_id is one conversation. Texts of any length are rendered whole. Other columns are not read; an
    empty table gives no row.
    """
    columns = ["conv_id", "ord", "role", "piece", "start", "end", "loss_start", "loss_end", "rewrites_history"]
    schema = "conv_id string, ord long, role string, piece string, start long, end long, loss_start long, loss_end long, rewrites_history boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, renderer = object(), Renderer(template)
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                if conv != current:
                    current, renderer = conv, Renderer(template)
                piece, start, place, rewritten = renderer.add((role, text), role == loss_role)
                rows.append((conv, renderer.n - 1, role, piece, start, start + len(piece), *(place or (None, None)), rewritten))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"loss_start": "Int64", "loss_end": "Int64"})

    ready = small_batches(conversations).select(
        # pandas would turn ids with a null among them into floating point
        F.col("conv_id").cast("string").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    made = dealt.select("conv_id", "role", "text").mapInPandas(run, schema)
    return made.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))


def conversation_digests(
    turns: DataFrame, read: Callable[[str], Turn] = read_turn, restore: Callable[[str], str] = unescape
) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_rewrites of format_turns' rows.

    Everything is read back from the rendered pieces: `read` gives the role and text of a turn's piece, and the text
    under the loss mask is cut out by its span and passed through `restore`. Rows must come as format_turns gives them
    (a conversation in one partition, in order); digests are updated turn by turn. formatted_chars is the length of the
    last turn's output. Of a template that rewrites history each turn counts as it was when it was appended.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            done = []
            columns = ("conv_id", "piece", "start", "end", "loss_from", "loss_to", "rewrites_history")
            for conv, piece, start, end, loss_from, loss_to, rewritten in zip(*(batch[c] for c in columns), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append(state)
                    current, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = read(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if loss_from >= 0:
                    masked = restore(piece[loss_from:loss_to])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] = end
                state[6] += bool(rewritten)
            yield _closed(done)
        if state is not None:
            yield _closed([state])

    at = lambda name: F.coalesce(F.col(name) - F.col("start"), F.lit(-1))
    ready = turns.select(F.col("conv_id").cast("string").alias("conv_id"), "piece", "start", "end", at("loss_start").alias("loss_from"), at("loss_end").alias("loss_to"), "rewrites_history")
    made = ready.mapInPandas(
        run,
        "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long",
    )
    return made.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def _closed(states: list) -> pd.DataFrame:
    rows = [[s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]] for s in states]
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"])
