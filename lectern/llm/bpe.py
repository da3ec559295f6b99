"""Byte-level BPE encoding and decoding.

Bytes are mapped one to one to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds every
token that occurs in a piece. Encoding walks the piece from its longest matches and steps back to shorter ones until
all neighbouring tokens are compatible: two tokens may stand side by side only if merging their joint bytes by rank
gives exactly these two. A sequence of such tokens is the one that the merges produce. Compatibility is remembered
for each pair, dead ends for each position, so a piece of n bytes takes time in proportion to n.

The vocabulary file is read by each Python worker from the path given (every node of the cluster needs the file).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Pieces kept in a worker's memory before it starts anew; bounds memory, never results.
CACHE_PIECES = 120_000
#: A space that is not a boundary between two runs of other characters: such texts are cut by the pattern as a whole.
_ODD_SPACE = re.compile(r"\s |\s\s| \s|^ | $")


class BytePairEncoder:
    """ranks: bytes of a token to its id, in order of merging; pattern: what cuts a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.id_text = {i: str(i) for i in self.tokens}
        self.cut = regex.compile(pattern)
        self.size: dict[int, int] = {}  # of the tokens that their own bytes merge to
        self.shorter: dict[int, int] = {}  # the longest of these that a token starts with, itself left out
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.merge(token) == [rank]:
                self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
                self.size[rank] = len(token)
        for rank, size in self.size.items():
            token = self.tokens[rank]
            prefixes = (ranks.get(token[:k], -1) for k in range(size - 1, 0, -1))
            self.shorter[rank] = next((x for x in prefixes if x in self.size), -1)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.width = max(self.tokens, default=0) + 1
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank until none is left. Used on single tokens at start."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joint = None
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
            if rank == 1 << 60:
                break
            joint = (self.ranks[parts[at]], self.ranks[parts[at + 1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 1 and joint:
            self.halves[self.ranks[piece]] = joint
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep the seam between the two tokens: undo their merges from the last one backwards; at
        no time may the tokens at the seam join at a lower rank than the merge that was undone."""
        key = left * self.width + right
        known = self.fits.get(key)
        if known is not None:
            return known
        if len(self.fits) > 2 * CACHE_PIECES:
            self.fits.clear()
        halves, tokens, ranks = self.halves, self.tokens, self.ranks
        limit, known = 1 << 60, True
        while True:
            if ranks.get(tokens[left] + tokens[right], limit) < limit:
                known = False
                break
            if left in halves and (left > right or right not in halves):
                limit, left = left, halves[left][1]
            elif right in halves:
                limit, right = right + 1, halves[right][0]
            else:
                break
        self.fits[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """One match of the pattern. A piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n  # matches come in order of their end, so the last one kept for a start is the longest
        for end, (reach, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - reach] = token
        dead = bytearray(n + 1)  # positions from which no compatible rest was found
        size, shorter = self.size, self.shorter
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = shorter[token]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def _run(self, text: str) -> tuple[int, ...]:
        """The ids of a text that starts where a piece starts."""
        got: list[int] = []
        for piece in self.cut.findall(text):
            got += self.encode_piece(piece.encode("utf-8"))
        return tuple(got)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text. Where single spaces stand between other characters a piece always starts at the space,
        so such texts are looked up run by run; all others are cut by the pattern as a whole."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces, self.older = {}, self.pieces
        if _ODD_SPACE.search(text):
            return list(self._run(text))
        known, older, found = self.pieces, self.older, []
        first, *rest = text.split(" ")
        found.append(self._run(first))
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = older.get(word) or self._run(" " + word)
                if len(word) <= 64:
                    known[word] = ids
            found.append(ids)
        return list(itertools.chain.from_iterable(found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def load_encoder(path: str, pattern: str) -> BytePairEncoder:
    """From a rank file: base64 of a token and its rank in each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return BytePairEncoder(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, emit_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs, and the ids themselves with emit_ids.

    A null text counts as empty: no token, digests of nothing. Texts of any length are encoded whole. Repeated rows are
    encoded each for itself, null ids too; columns other than doc_id and text are not read, and an empty table gives
    none. Decoding goes back from the ids.
    """
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if emit_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = load_encoder(path, pattern)
        as_text = coder.id_text
        for texts in batches:
            rows = []
            for text in texts:
                ids = coder.encode(text) if text else []
                listed = ",".join([as_text[i] for i in ids])
                row = [len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()]
                rows.append([*row, ids] if emit_ids else row)
            yield pd.DataFrame(rows, columns=[f.name for f in fields])

    # ids stay in the JVM: pandas would turn a column with a null into floating point
    coded = F.pandas_udf(encode, T.StructType(fields))("text")
    return small_batches(docs).select("doc_id", coded.alias("coded")).select("doc_id", "coded.*")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of rows with doc_id, ids. Null ids give an empty text; bytes that are no UTF-8 are replaced."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = load_encoder(path, pattern)
        for ids in batches:
            yield pd.Series([coder.decode([] if x is None else list(x)).decode("utf-8", "replace") for x in ids], dtype=object)

    return small_batches(encoded).select("doc_id", F.pandas_udf(decode, "string")("ids").alias("text"))
