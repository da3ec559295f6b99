"""Text functions: Column to Column, all inside the JVM. A null text counts as empty unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import params as P

CJK = "\\u4e00-\\u9fff"
_RUNS = f"([A-Za-z0-9_]+|[{CJK}]+)"
_STRINGS = "array<string>"
#: White space of Unicode but for the space itself, as a class and as characters.
_SPACES = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES_AS_TEXT = "".join(map(chr, [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row: inside a lambda an outer expression would be computed anew
    for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: A run of white space that is not one single space; a character of another kind fails at the first class.
_UNEVEN = "[ {0}](?:[ {0}]+|(?<! ))"
_WIDE_SPACES = r"[\x85\xa0\u1680\u2000-\u3000]"


def collapse(c: Column) -> Column:
    """All white space runs to one space, none at the ends. Single spaces, the most of them, need no replacing, and most
    texts have white space of ASCII only, whose class is a lookup."""
    text = text_or_empty(c)
    ascii_only = F.regexp_replace(text, _UNEVEN.format(r"\t-\r"), " ")
    return F.trim(F.when(text.rlike(_WIDE_SPACES), F.regexp_replace(text, _UNEVEN.format(_SPACES), " ")).otherwise(ascii_only))


def strip(c: Column) -> Column:
    return F.btrim(text_or_empty(c), F.lit(" " + _SPACES_AS_TEXT))


def empty_strings() -> Column:
    return F.array().cast(_STRINGS)


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | c.contains(term)
    return out


def ngrams(c: Column, width: int) -> Column:
    """All substrings of the width, in order; none for a shorter text (a sequence to 0 would count down)."""
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - width + 1), lambda i: F.substr(c, i, F.lit(width)))
    return F.when(F.length(c) >= width, grams).otherwise(empty_strings())


def _ascii_lower(text: Column) -> Column:
    """Of ASCII letters the lower case, for searches of ASCII runs. lower is much faster than translate, and two characters
    only have a lower case within ASCII without being of it: dotted capital I and the Kelvin sign."""
    odd = contains_any(text, ("\u0130", "\u212a"))
    return F.when(odd, F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def tokenize_lexical(c: Column) -> Column:
    """Latin runs in lower case; CJK runs whole up to 8 characters, and all their 2- and 3-grams. A run of one CJK
    character counts twice."""

    def run(r: Column) -> Column:
        whole = F.when(F.length(r) <= 8, F.array(r)).otherwise(empty_strings())
        rest = F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(ngrams(r, 2), ngrams(r, 3)))
        return F.when(r.rlike("^[A-Za-z0-9_]"), F.array(F.lower(r))).otherwise(F.concat(whole, rest))

    text = text_or_empty(c)
    # most texts have Latin runs only, which need no work on each token
    latin = F.regexp_extract_all(_ascii_lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    mixed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_RUNS), F.lit(1)), run))
    return F.when(text.rlike(f"[{CJK}]"), mixed).otherwise(latin)


def counted(tokens: Column) -> Column:
    """array<struct<token, n>>: how often each token stands in the list, in the order of the tokens. Equal tokens stand
    together in the sorted list, so its places where a token begins give the counts; nothing leaves the row."""

    def count(s: Column) -> Column:
        # the places go up to the size itself, where no token is
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        each = lambda ss: F.transform(F.slice(ss, 1, F.size(ss) - 1), lambda at, k: F.struct(F.get(s, at).alias("token"), (F.get(ss, k + 1) - at).alias("n")))
        return F.when(F.size(s) > 0, let(starts, each)).otherwise(F.array().cast("array<struct<token:string,n:int>>"))

    return let(F.sort_array(tokens), count)


def constant_tokens(text: str) -> Column:
    """tokenize_lexical of a text that is known beforehand, as a literal: plans stay small."""
    out = []
    for run in re.findall("[A-Za-z0-9_]+|[\u4e00-\u9fff]+", text):
        if run[0] < "\u4e00":
            out.append(run.lower())
        else:
            out += [run] if len(run) <= 8 else []
            out += [run] if len(run) == 1 else [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
    return F.array(*map(F.lit, out)).cast(_STRINGS)


def tokenize_embedding(c: Column) -> Column:
    """Latin runs without underscore and single CJK characters, then the pairs of CJK characters that follow each
    other in the list of CJK characters, even across a gap."""
    low = F.lower(text_or_empty(c))
    single = F.regexp_extract_all(low, F.lit(f"([a-z0-9]+|[{CJK}])"), F.lit(1))
    chars = F.regexp_extract_all(low, F.lit(f"([{CJK}])"), F.lit(1))

    def pairs(cs: Column) -> Column:
        both = F.transform(F.sequence(F.lit(0), F.size(cs) - 2), lambda i: F.concat(cs[i], cs[i + 1]))
        return F.when(F.size(cs) >= 2, both).otherwise(empty_strings())

    return F.concat(single, let(chars, pairs))


def tokenize_citation(c: Column, stop_chars: str = P.CITATION_STOP_CHARS) -> Column:
    """Words of two characters or more; of CJK runs the characters that are no stop characters, and all pairs."""

    def run(r: Column) -> Column:
        chars = F.filter(F.split(r, ""), lambda x: ~F.lit(stop_chars).contains(x) & (x != ""))
        word = F.when(F.length(r) > 1, F.array(r)).otherwise(empty_strings())
        return F.when(r.rlike("^[a-z0-9_]"), word).otherwise(F.concat(chars, ngrams(r, 2)))

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(_RUNS), F.lit(1)), run))


def tokenize_web_query(c: Column, stops: Sequence[str] = P.WEB_STOPS) -> Column:
    """The set of words and CJK runs of two characters or more, without stop words."""
    runs = F.regexp_extract_all(text_or_empty(c), F.lit("([A-Za-z0-9_]{2,}|[\\u3400-\\u9fff]{2,})"), F.lit(1))
    return F.array_except(F.transform(runs, F.lower), F.array(*map(F.lit, stops)))


def normalize_query(c: Column, stops: Sequence[str] = P.QUERY_STOPS) -> Column:
    out = F.lower(text_or_empty(c))
    for stop in sorted(stops, key=len, reverse=True):
        out = F.replace(out, F.lit(stop), F.lit(" "))
    return out


def query_tokens(normalized: Column) -> Column:
    """Lexical tokens without numbers of fewer than four digits."""
    return F.filter(tokenize_lexical(normalized), lambda t: ~t.rlike("^[0-9]{1,3}$"))


def expand_query(query: Column, tokens: Column, synonyms: Mapping[str, Sequence[str]] = P.SYNONYMS) -> Column:
    """tokens, and the tokens of all additions whose trigger stands in the query or shares a token with it."""
    def expand(own: Column) -> Column:
        out = own
        for trigger, additions in synonyms.items():
            fires = F.lower(text_or_empty(query)).contains(trigger) | F.arrays_overlap(own, constant_tokens(trigger))
            added = F.concat(*[constant_tokens(a) for a in additions])
            out = F.concat(out, F.when(fires, added).otherwise(empty_strings()))
        return out

    return let(tokens, expand)


def query_phrases(c: Column, stops: Sequence[str] = P.QUERY_STOPS) -> Column:
    """Runs of two characters or more; CJK runs are cut at stop phrases."""

    def run(r: Column) -> Column:
        cleaned = r
        for stop in stops:
            cleaned = F.replace(cleaned, F.lit(stop), F.lit(" "))
        parts = F.filter(F.split(cleaned, " "), lambda p: F.length(p) >= 2)
        whole = F.when(F.length(r) >= 2, F.array(r)).otherwise(empty_strings())
        return F.when(r.isin(*stops), empty_strings()).when(r.rlike("^[a-z0-9_]"), whole).otherwise(parts)

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(_RUNS), F.lit(1)), run))


def semantic_features(c: Column, stops: Sequence[str] = P.QUERY_STOPS) -> Column:
    """The set of lexical tokens of two characters or more without stop words, and of all 4-character shingles of the
    lower-case text without white space."""
    words = F.filter(tokenize_lexical(c), lambda t: (F.length(t) >= 2) & ~t.isin(*stops))
    compact = F.regexp_replace(F.lower(text_or_empty(c)), r"(?U)\s+", "")
    return F.array_union(words, let(compact, lambda t: ngrams(t, 4)))


def _last_index(c: Column, mark: str) -> Column:
    """1-based position of the last occurrence, 0 without one; mark is one character."""
    at = F.locate(mark, F.reverse(c))
    return F.when(at > 0, F.length(c) - at + 1).otherwise(0)


def compact_sentence(c: Column, limit: int = 150) -> Column:
    """Collapsed; a longer text is cut behind its last full stop within the limit if that is not within the first 40
    characters, else at the limit with three dots."""
    clean = collapse(c)
    head = F.substr(clean, F.lit(1), F.lit(limit))
    at = F.greatest(*[_last_index(head, m) for m in "。；."])
    cut = F.when(at > 40, F.substr(clean, F.lit(1), at)).otherwise(F.concat(F.rtrim(head), F.lit("...")))
    return F.when(F.length(clean) <= limit, clean).otherwise(cut)


def compact_text(c: Column, limit: int) -> Column:
    """Collapsed and cut at the limit, with three dots."""
    clean = collapse(c)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(F.substr(clean, F.lit(1), F.lit(limit))), F.lit("...")))


def clip_text(c: Column, limit: int) -> Column:
    return F.substr(strip(c), F.lit(1), F.lit(limit))


def compress_text(c: Column, max_chars: int = 260) -> Column:
    """A longer text becomes its first 18 runs, dots and its end."""
    clean = collapse(c)
    prefix = F.array_join(F.slice(F.regexp_extract_all(clean, F.lit(_RUNS), F.lit(1)), 1, 18), " ")
    rest = F.lit(max_chars) - F.length(prefix) - 4
    both = F.concat(prefix, F.lit(" ... "), F.right(clean, rest))
    hard = F.concat(F.substr(clean, F.lit(1), F.lit(max_chars - 1)), F.lit("…"))
    return F.when(F.length(clean) <= max_chars, clean).when((prefix != "") & (rest > 30), both).otherwise(hard)


def bounded_join(parts: Column, max_chars: int) -> Column:
    """Parts, collapsed, joined by line feeds while they fit; the first that does not is clipped with a mark, and what
    follows is left out."""
    clean = F.filter(F.transform(parts, collapse), lambda p: p != "")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def add(state: Column, part: Column) -> Column:
        joined = F.when(state.out == "", part).otherwise(F.concat_ws("\n", state.out, part))
        left = F.lit(max_chars) - F.length(state.out) - F.when(state.out == "", 0).otherwise(1)
        clipped = F.concat(F.substr(part, F.lit(1), F.greatest(left - 1, F.lit(0))), F.lit("…"))
        last = F.when(left <= 0, state.out).when(state.out == "", clipped).otherwise(F.concat_ws("\n", state.out, clipped))
        fits = F.length(joined) <= max_chars
        return F.struct(F.when(state.full, state.out).when(fits, joined).otherwise(last).alias("out"), (state.full | ~fits).alias("full"))

    return F.aggregate(clean, start, add, lambda s: s.out)


def pick_keyword(c: Column, tokens: Column | None = None) -> Column:
    """First preferred term in the text; else the first CJK run of 2 to 8 characters that is no stop term; else the
    most frequent token of two characters or more, the first seen of equals; else a default. tokens: the text's lexical
    tokens where they are known, null where not."""
    text = text_or_empty(c)
    preferred = F.coalesce(*[F.when(text.contains(t), F.lit(t)) for t in P.PREFERRED_TERMS])
    cjk = F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,8}})"), F.lit(1))
    first = F.get(F.filter(cjk, lambda t: ~t.isin(*P.KEYWORD_STOPS)), F.lit(0))
    own = tokenize_lexical(c) if tokens is None else F.coalesce(tokens, tokenize_lexical(c))
    seen = F.filter(own, lambda t: F.length(t) > 1)

    def frequent(tokens: Column) -> Column:
        most = lambda cs: let(F.array_max(F.transform(cs, lambda x: x.n)), lambda m: F.transform(F.filter(cs, lambda x: x.n == m), lambda x: x.token))
        # an intersection keeps the order of its first list
        return F.get(F.array_intersect(tokens, let(counted(tokens), most)), F.lit(0))

    return F.coalesce(preferred, first, let(seen, frequent), F.lit(P.DEFAULT_KEYWORD))


def split_sentences(c: Column) -> Column:
    """Sentences of an answer: heading lines go, bullets and numbers go from the line starts; cut behind full-width
    stops, question and exclamation marks and semicolons, never behind an ASCII full stop; labels that follow stay."""
    lines = F.transform(F.split(text_or_empty(c), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), strip)
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*[-*+]\s+", ""), r"^\s*\d+[.)、]\s+", ""))
    # a line holds no line feed, so one marks the cuts; a search for stops alone reads a line once
    end = r"(?U)([。！？!?；;](?:\s*\[[A-Za-z]?\d+\])*)"
    parts = F.transform(bare, lambda x: F.split(F.regexp_replace(x, end, "$1\n"), "\n"))
    return F.filter(F.transform(F.flatten(parts), strip), lambda s: s != "")


def redact_secrets(c: Column, limit: int = 300) -> Column:
    hidden = F.regexp_replace(text_or_empty(c), r"sk-[A-Za-z0-9_\-]+", "sk-***")
    return F.substr(collapse(hidden), F.lit(1), F.lit(limit))


def stable_id(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(text_or_empty(c)), 1, length)


def point_id(title: Column) -> Column:
    return F.concat(F.lit("kp-"), stable_id(F.lower(strip(title)), 12))


def mistake_id(point: Column, question: Column, at: Column) -> Column:
    return F.concat(F.lit("mistake-"), stable_id(F.concat_ws("|", point, text_or_empty(question), at), 12))


def safe_id(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), r"[^\p{IsAlphabetic}\p{IsDigit}]", "_")


def coerce_int(c: Column, default: int = 0, low: int | None = None, high: int | None = None) -> Column:
    """A number, or a text of one, as an integer; else the default; then within the bounds."""
    out = F.coalesce(F.expr("0").cast("long") + c.try_cast("long"), F.lit(default).cast("long"))
    out = F.greatest(out, F.lit(low).cast("long")) if low is not None else out
    return F.least(out, F.lit(high).cast("long")) if high is not None else out


def coerce_score(c: Column, default: int = 50) -> Column:
    """Rounded half to even, within 0 and 100."""
    number = c.try_cast("double")
    number = F.when(F.isnan(number), F.lit(None)).otherwise(number)
    return F.least(F.greatest(F.rint(F.coalesce(number, F.lit(float(default)))), F.lit(0.0)), F.lit(100.0)).cast("int")


def coerce_choice(c: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))
