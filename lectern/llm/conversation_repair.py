"""Repair of conversations by weighted CYK parsing over a repair grammar.

The roles of a repaired conversation form a regular language, given as a small automaton. The grammar in Chomsky normal
form has a nonterminal [p, q] for each pair of states, for what leads from p to q: binary rules [p, q] -> [p, r] [r, q],
and leaf rules that edit one row (keep it, give it another role, delete it). A cell holds, for each nonterminal over its
span, the least (cost, audit), audit being the letters of the edits, and is closed under insertions of rows at either
end. Cells are combined bottom-up by span length. Since every derivation of a span passes each place between two of its
rows in exactly one state, any one place to split a span gives the same cell as all of them: spans double in length, and a
conversation of n rows takes n - 1 combinations instead of n^3.

Taking the least audit of each cell is right although audits are concatenated: audits of one span and equal cost are never
prefixes of each other, because what the longer one adds could only be insertions, which cost.

On Spark the rows are put in order by a range partitioning that splits long conversations between tasks; pieces of a
conversation are parsed in parallel over their flags alone, the cells of its pieces meet in one task, and each piece gets
back the part of the audit that is its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

Cell = list[tuple[int, str] | None]  # at p * states + q
#: Rows of a piece of a conversation.
PIECE = 512
#: Edits that leave a task at once.
EDIT_ROWS = 20_000
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)


@dataclass(frozen=True)
class RepairGrammar:
    """Roles are known by their first letters. moves: (state, letter) to the state behind it; inserted: the roles that
    edits may give or insert. Of these at most one may follow each state, so that an audit tells the repaired roles. The
    default says (s?(ua)+)?: nothing, or an optional system row and pairs of a user and an assistant row."""

    states: int = 4
    start: int = 0
    accepting: tuple[int, ...] = (0, 3)
    moves: dict[tuple[int, str], int] = field(
        default_factory=lambda: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    )
    inserted: tuple[str, ...] = ("user", "assistant")
    rerole_cost: int = 2
    delete_cost: int = 3
    insert_cost: int = 2
    truncated_cost: int = 1

    def __post_init__(self) -> None:
        for p in range(self.states):
            if sum((p, role[0]) in self.moves for role in self.inserted) > 1:
                raise ValueError(f"several inserted roles may follow state {p}")
        if min(self.rerole_cost, self.delete_cost, self.insert_cost) < 1:
            raise ValueError("edits other than keeping cost 1 or more")

    def given(self, state: int) -> str | None:
        """The role that an insertion or a change of role gives behind this state."""
        return next((role for role in self.inserted if (state, role[0]) in self.moves), None)


class Parser:
    """Cells of one grammar."""

    def __init__(self, grammar: RepairGrammar) -> None:
        self.grammar, self.n = grammar, grammar.states
        self.leaves: dict[tuple[str, int], Cell] = {}
        self.closure = self._closure()

    def _closure(self) -> Cell:
        """From p to q by insertions alone."""
        g, n = self.grammar, self.n
        out: Cell = [None] * (n * n)
        for p in range(n):
            state, letters = p, ""
            while out[p * n + state] is None:
                out[p * n + state] = (len(letters) * g.insert_cost, letters)
                role = g.given(state)
                if role is None:
                    break
                state, letters = g.moves[state, role[0]], letters + "I"
        return out

    def leaf(self, letter: str, fault: int) -> Cell:
        """The cell of one row."""
        known = self.leaves.get((letter, fault))
        if known is not None:
            return known
        g, n = self.grammar, self.n
        own: Cell = [None] * (n * n)
        more = g.truncated_cost if fault == TRUNCATED else 0
        for p in range(n):
            edits = [(g.delete_cost, "D", p)]
            if fault in (FINE, TRUNCATED):
                if (p, letter) in g.moves:
                    edits.append((more, "K", g.moves[p, letter]))
                role = g.given(p)
                if role is not None:
                    edits.append((g.rerole_cost + more, "R", g.moves[p, role[0]]))
            for cost, edit, q in edits:
                at = p * n + q
                own[at] = min(own[at] or (cost, edit), (cost, edit))
        cell = self.leaves[letter, fault] = self.combine(self.combine(self.closure, own), self.closure)
        return cell

    def combine(self, left: Cell, right: Cell) -> Cell:
        n = self.n
        out: Cell = [None] * (n * n)
        for p in range(n):
            row = [(r, left[p * n + r]) for r in range(n) if left[p * n + r] is not None]
            for q in range(n):
                best = None
                for r, a in row:
                    b = right[r * n + q]
                    if b is None:
                        continue
                    cost = a[0] + b[0]
                    if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                        best = (cost, a[1] + b[1])
                out[p * n + q] = best
        return out

    def levels(self, cells: Sequence[Cell]) -> list[list[Cell]]:
        """The cells of spans of 1, 2, 4, ... cells, up to the whole."""
        out = [list(cells)]
        while len(out[-1]) > 1:
            below = out[-1]
            out.append([self.combine(*below[i : i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
        return out

    def parts(self, cells: Sequence[Cell]) -> tuple[int, list[tuple[int, str]]]:
        """The least cost, and of each cell the state it begins in and its part of the least audit."""
        g, n, levels = self.grammar, self.n, self.levels(cells)
        top = levels[-1][0]
        whole, end = min((top[g.start * n + q], q) for q in g.accepting if top[g.start * n + q] is not None)
        spans = [(g.start, end)]
        for below in reversed(levels[:-1]):
            split = []
            for i, (p, q) in enumerate(spans):
                if 2 * i + 1 == len(below):
                    split.append((p, q))
                    continue
                left, right = below[2 * i : 2 * i + 2]
                ways = [(left[p * n + r], right[r * n + q], r) for r in range(n)]
                r = min((a[0] + b[0], a[1] + b[1], r) for a, b, r in ways if a is not None and b is not None)[2]
                split += [(p, r), (r, q)]
            spans = split
        return whole[0], [(p, cell[p * n + q][1]) for cell, (p, q) in zip(cells, spans, strict=True)]

    def replay(self, state: int, audit: str, letters: str) -> Iterator[tuple[int, str, str | None]]:
        """Number of the row (for an insertion, of the row it stands before, or of the last one), edit, given role."""
        g, row = self.grammar, 0
        for edit in audit:
            role = g.given(state) if edit in "RI" else None
            yield min(row, len(letters) - 1), edit, role
            if edit != "D":
                state = g.moves[state, role[0] if role else letters[row]]
            row += edit != "I"


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, with `at`, which rises with conv_id, turn, role, text (nulls first), and without their texts each row's
    first fault: BLANK, DUPLICATE, TRUNCATED or FINE."""
    keys = ["conv_id", "turn", "role", "text"]
    ready = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    # equal rows are as good as each other: numbered, they need not all go to one task
    spread = ready.withColumn("nth", F.monotonically_increasing_id())
    sorted_rows = spread.repartitionByRange(*keys, "nth").sortWithinPartitions(*keys, "nth").drop("nth")
    ordered = materialise(sorted_rows.withColumn("at", F.monotonically_increasing_id()))
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    flags = ordered.select("at", "conv_id", F.col("turn").cast("string").alias("turn"), F.substring("role", 1, 1).alias("letter"), last.alias("last"))
    firsts = ordered.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("at"))
    marked = flags.join(firsts.select("at", F.lit(True).alias("is_first")), "at", "left")
    fault = (
        F.when(F.col("last") == "", BLANK)
        .when(F.col("is_first").isNull(), DUPLICATE)
        .when(~F.col("last").isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    return ordered, marked.select("at", "conv_id", "turn", "letter", fault.alias("fault"))


_PIECE = (
    "conv string, is_null boolean, piece long, first_at long, letters string, first_letter string, last_letter string, blank long, duplicate long, "
    "truncated long, illegal long, turns long, first_turn string, last_turn string, costs array<long>, audits array<string>"
)
_PART = (
    "conv string, is_null boolean, first_at long, state int, own_audit string, letters string, is_last boolean, gaps long, blank long, "
    "duplicate long, truncated long, illegal long, cost long, audit string"
)
_LEGAL = {"su", "ua", "au"}


def _pieces(grammar: RepairGrammar) -> Callable:
    """Rows in order of at to a row for each piece of each conversation."""

    def close(rows: list[tuple], parser: Parser) -> tuple:
        conv, is_null, piece = rows[0][:3]
        letters = [r[5] for r in rows]
        known = {letter for _, letter in grammar.moves}
        seen = [r[6] for r in rows]
        turns = [r[4] for r in rows if r[4] is not None]
        cell = parser.levels([parser.leaf(letter, fault) for letter, fault in zip(letters, seen, strict=True)])[-1][0]
        return (
            conv, is_null, piece, rows[0][3], "".join(x if x in known else "-" for x in letters), letters[0], letters[-1],
            seen.count(BLANK), seen.count(DUPLICATE), seen.count(TRUNCATED),
            sum(a + b not in _LEGAL for a, b in zip(letters, letters[1:], strict=False)),
            len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None,
            [c[0] if c else -1 for c in cell], [c[1] if c else "" for c in cell],
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser, waiting = Parser(grammar), []
        for batch in batches:
            done = []
            for row in zip(*(batch[c].tolist() for c in ("conv", "is_null", "piece", "at", "turn", "letter", "fault")), strict=True):
                if waiting and row[:3] != waiting[0][:3]:
                    done.append(close(waiting, parser))
                    waiting = []
                waiting.append(row)
            yield _frame(done, _PIECE)
        if waiting:
            yield _frame([close(waiting, parser)], _PIECE)

    return run


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _parts(grammar: RepairGrammar) -> Callable:
    """A conversation's pieces in order to a row for each piece with its own part of the audit; the last piece's row has
    the whole conversation's figures."""
    columns = [c.split()[0] for c in _PIECE.split(", ")]

    def close(pieces: list[dict], parser: Parser) -> Iterator[tuple]:
        cells = [[None if c < 0 else (int(c), a) for c, a in zip(x["costs"], x["audits"], strict=True)] for x in pieces]
        cost, parts = parser.parts(cells)
        dated = [x for x in pieces if x["turns"]]
        turns = sum(x["turns"] for x in dated) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:], strict=False))
        gaps = int(dated[-1]["last_turn"]) - int(dated[0]["first_turn"]) + 1 - turns if dated else 0
        total = [sum(x[c] for x in pieces) for c in ("blank", "duplicate", "truncated", "illegal")]
        total[3] += sum(a["last_letter"] + b["first_letter"] not in _LEGAL for a, b in zip(pieces, pieces[1:], strict=False))
        for i, (x, (state, own)) in enumerate(zip(pieces, parts, strict=True)):
            last = i + 1 == len(pieces)
            figures = (gaps, *total, cost, "".join(a for _, a in parts)) if last else (None,) * 7
            yield (x["conv"], x["is_null"], x["first_at"], state, own, x["letters"], last, *figures)

    def finish(pieces: list[dict], parser: Parser) -> pd.DataFrame:
        rows = [row for group in pieces for row in close(group, parser)]
        return _frame(rows, _PART).astype({c: "Int64" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser, group = Parser(grammar), []
        for batch in batches:
            done = []
            for values in zip(*(batch[c].tolist() for c in columns), strict=True):
                x = dict(zip(columns, values, strict=True))
                if group and (x["conv"], x["is_null"]) != (group[0]["conv"], group[0]["is_null"]):
                    done.append(group)
                    group = []
                group.append(x)
            yield finish(done, parser)
        if group:
            yield finish([group], parser)

    return run


def _edits(grammar: RepairGrammar) -> Callable:
    names = ["at", "k", "edit", "given"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser, rows = Parser(grammar), []
        for batch in batches:
            for first, state, audit, letters in zip(*(batch[c].tolist() for c in ("first_at", "state", "own_audit", "letters")), strict=True):
                rows += [(first + row, k, edit, role) for k, (row, edit, role) in enumerate(parser.replay(state, audit, letters))]
                if len(rows) > EDIT_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    return run


@dataclass(frozen=True)
class Repair:
    """ordered: the rows with `at`. edits: at, k, edit (K, R, D or I), given (the role of R and I), in order of at and k;
    an insertion has the `at` of a neighbour. figures: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""

    ordered: DataFrame
    edits: DataFrame
    figures: DataFrame

    def rows(self) -> DataFrame:
        """conv_id, at, k, edit, role, text: the repaired conversations, in order of at and k."""
        told = self.edits.filter("edit <> 'D'").join(self.ordered, "at")
        text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
        return told.select("conv_id", "at", "k", "edit", F.coalesce("given", "role").alias("role"), text.alias("text"))


def repair_conversations(rows: DataFrame, grammar: RepairGrammar | None = None) -> Repair:
    """The cheapest repair of every conversation of rows (conv_id, turn, role, text).

    A row's first fault counts: blank (no character but ASCII white space; a null text or role is one space), duplicate
    (role and text stand earlier in the conversation), truncated (the last character that is not white space is none of
    `.!?`). Blank and duplicate rows are deleted; of what is left the cheapest edits win that give a sequence of roles of
    the grammar, ties by the audit that is least in ASCII.

    Rows are taken by turn, then role, then text, nulls first; of equal rows all but the first are duplicates. A null
    conv_id is one conversation. An empty role fits nowhere. Texts of any length are read whole, inside the JVM. Other
    columns are not read; an empty table gives no row. A conversation is split into pieces of PIECE rows at most, so
    that a giant one is parsed by many tasks; the task that joins its pieces holds about ten letters for each of its
    rows, and no text.
    """
    grammar = grammar or RepairGrammar()
    ordered, flags = faults(small_batches(rows))
    conv = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNull().alias("is_null")]
    flags = flags.select(*conv, F.floor(F.col("at") / PIECE).alias("piece"), "at", "turn", "letter", "fault")
    dealt = flags.repartition("conv", "piece").sortWithinPartitions("at")
    pieces = dealt.mapInPandas(_pieces(grammar), _PIECE)
    met = pieces.repartition("conv", "is_null").sortWithinPartitions("conv", "is_null", "piece")
    parts = materialise(met.mapInPandas(_parts(grammar), _PART))
    own = parts.select("first_at", "state", "own_audit", "letters").repartition("first_at")
    edits = own.mapInPandas(_edits(grammar), "at long, k int, edit string, given string")
    back = F.when(~F.col("is_null"), F.col("conv")).cast(ordered.schema["conv_id"].dataType).alias("conv_id")
    named = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(ordered, edits, parts.filter("is_last").select(back, *named))


def text_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of `role:text` of the rows of Repair.rows(), joined by line feeds. Rows stream through a
    task in order; a digest is one state, whatever the conversation's length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for conv, is_null, line in zip(batch["conv"].tolist(), batch["is_null"].tolist(), batch["line"].tolist(), strict=True):
                if (conv, is_null) != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (conv, is_null), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            yield pd.DataFrame(done, columns=["conv", "is_null", "repaired_sha256"])
        if state is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["conv", "is_null", "repaired_sha256"])

    conv = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNull().alias("is_null")]
    lines = repaired.select(*conv, "at", "k", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv", "is_null").sortWithinPartitions("conv", "is_null", "at", "k").drop("at", "k")
    made = dealt.mapInPandas(run, "conv string, is_null boolean, repaired_sha256 string")
    back = F.when(~F.col("is_null"), F.col("conv")).cast(repaired.schema["conv_id"].dataType).alias("conv_id")
    return made.select(back, "repaired_sha256")


def repair_report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, the figures of Repair, repaired_sha256 for every row of ids (conv_id, each once); an id without rows has
    zeros, an empty audit and the digest of nothing, as has a conversation of which nothing is left."""
    repair = repair_conversations(rows)

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("conv_id", "right_id")
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("right_id")), "left").drop("right_id")

    out = beside(beside(ids, repair.figures), text_digests(repair.rows()))

    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers]
    digest = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), digest)
