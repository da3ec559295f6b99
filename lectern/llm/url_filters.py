"""URL filters by a bit-parallel wildcard automaton.

Every glob rule is a run of bits in a row of 64-bit words: one bit for the state before its first character and one
behind each character that it consumes. For each byte of a URL all patterns step at once: shift the state by one bit,
mask it with the states that may be entered on this byte, and keep the states whose wildcard loops on it. The URLs of
an Arrow batch step together, so a step is a handful of numpy operations on a (URLs x words) matrix.

Globs are anchored at both ends of the canonical URL, `.` + host + path: `?` is one byte but `/`, `*` any run without
`/`, `**` any run. A rule `host/path` holds for the host, its subdomains and all longer paths: `*.host/path**`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: (rule, verdict): host, `/` and the start of the path. The longest rule that fits decides.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Globs that block a page for which no host rule speaks.
BLOCK_GLOBS = (
    "*.ads.**", "*.adserver.**", "*.doubleclick.**", "*.tracker.**", "*.casino.**", "*.porn**", "*.xxx/**", "*.onion/**",
    "**/ads/**", "**/ad/click**", "**/login", "**/login/**", "**/signin**", "**/logout**", "**/cart/**", "**/checkout/**",
    "**/wp-admin/**", "**/wp-login.php", "**/cgi-bin/**", "**/feed/", "**.exe", "**.zip", "**.tar.gz", "**.jpg", "**.jpeg",
    "**.png", "**.gif", "**.mp4", "**.css", "**.js", "**/tag/?", "**/page/???????*", "**//**",
)
#: Bytes of the padded block in which URLs step together.
_BLOCK_BYTES = 1 << 22


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class GlobAutomaton:
    """patterns packed into masks; final[p] is the bit of pattern p's last state."""

    patterns: Sequence[str]

    def __post_init__(self) -> None:
        steps = [self._states(p) for p in self.patterns]
        n_bits = sum(len(s) for s in steps)
        self.words = max(1, -(-n_bits // 64))
        enter, loop = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        start, self.final, bit = np.zeros(self.words * 64, bool), [], 0
        for states in steps:
            start[bit] = True
            for accepts, loops in states:
                enter[:, bit], loop[:, bit] = accepts, loops
                bit += 1
            self.final.append(bit - 1)
        pack = lambda m: np.packbits(m, axis=-1, bitorder="little").view("<u8").astype(np.uint64)
        self.enter, self.loop, self.start = pack(enter), pack(loop), pack(start)

    @staticmethod
    def _states(pattern: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each state the bytes that lead into it and the bytes that keep it."""
        none, slash = np.zeros(256, bool), np.zeros(256, bool)
        slash[ord("/")] = True
        states, i, raw = [[none, none]], 0, pattern.encode("utf-8")
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                states[-1][1], i = ~none, i + 2
            elif raw[i : i + 1] == b"*":
                states[-1][1], i = states[-1][1] | ~slash, i + 1
            else:
                one = ~slash
                if raw[i : i + 1] != b"?":
                    one = np.zeros(256, bool)
                    one[raw[i]] = True
                states.append([one, none])
                i += 1
        return [(a, b) for a, b in states]

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """(URLs x patterns): whether the pattern fits the whole URL."""
        out = np.zeros((len(urls), len(self.patterns)), bool)
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            rows = order[at : at + max(1, _BLOCK_BYTES // max(1, width))]
            at += len(rows)
            out[rows] = self._block([urls[i] for i in rows], lengths[rows], width)
        return out

    def _block(self, urls: list[bytes], lengths: np.ndarray, width: int) -> np.ndarray:
        text = np.zeros((width, len(urls)), np.uint8)
        for i, url in enumerate(urls):
            text[: len(url), i] = np.frombuffer(url, np.uint8)
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        active = np.searchsorted(-lengths, -np.arange(width), side="left")  # URLs longer than the position: a prefix
        one, top = np.uint64(1), np.uint64(63)
        for k in range(width):
            now, byte = state[: active[k]], text[k, : active[k]]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[: active[k]] = (moved & self.enter[byte]) | (now & self.loop[byte])
        bits = np.array(self.final)
        return (state[:, bits // 64] >> (bits % 64).astype(np.uint64) & one).astype(bool)


def filter_urls(
    pages: DataFrame,
    host_rules: Sequence[tuple[str, str]] = HOST_RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """page_id, url, host, path, rule, verdict, globs for every row of pages.

    rule is the longest host rule that fits, null without one; its verdict counts. Without a rule a page is blocked if
    one of the globs fits and allowed otherwise. globs lists all globs that fit. A null URL, or one without ://, has
    an empty host and path, which no host rule fits. Repeated rows are judged each for itself; an empty table gives
    none; other columns are not read. URLs are matched whole, however long.
    """
    ranked = sorted(host_rules, key=lambda r: -len(r[0]))
    judged_type = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("rule", "verdict")] + [T.StructField("globs", T.ArrayType(T.StringType()))]
    )

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = GlobAutomaton([f"*.{rule}**" for rule, _ in ranked] + list(block_globs))
        names = np.array([rule for rule, _ in ranked] + [None], object)
        said = np.array([verdict for _, verdict in ranked] + [None], object)
        globs = np.array(block_globs, object)
        for host, path in batches:
            hits = automaton.match(("." + host + path).str.encode("utf-8").tolist())
            by_rule, by_glob = hits[:, : len(ranked)], hits[:, len(ranked) :]
            first = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1) if len(ranked) else 0, len(ranked))
            blocked = np.where(by_glob.any(axis=1), "block", "allow")
            verdict = np.where(first < len(ranked), said[first], blocked)
            yield pd.DataFrame({"rule": names[first], "verdict": verdict, "globs": [globs[row].tolist() for row in by_glob]})

    ready = small_batches(pages).select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = ready.withColumn("judged", F.pandas_udf(judge, judged_type)("host", "path"))
    return judged.select("page_id", "url", "host", "path", "judged.*")
