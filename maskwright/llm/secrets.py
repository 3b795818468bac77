"""Secret scans: fixed patterns, and strings that a vocabulary cannot shorten.

Base patterns find assignments of passwords and keys, access keys and long runs of
hexadecimal digits; matches are leftmost and do not overlap within a kind, and those that are
too short are dropped after matching.

The method looks at runs of at least ``LEAST_RUN`` characters of keys (letters, digits and ``+/_=-``).
Known harmless forms are set aside: digests (hexadecimal runs of the usual digests' lengths), UUIDs,
dates and numbers.  Every other run is tokenised by a tiktoken vocabulary, which knows prose by long tokens and random
strings by short ones.  A run of fewer characters a token than ``LIMITS`` allows its form and length is a span of kind
``random``, unless a base span has it already.  Forms differ in how close words come to random strings: mixed runs, identifiers
(every part between ``_``, ``-``, ``/`` or a change of case is letters, or a short number; if signs separate the parts, only
their letters count), and single words of one case, which the vocabulary tells apart from random letters from 20 on well and
below in part.

Positions count code points, the end is not included.  Nulls: a null text has no spans.  Ties: spans of equal start are in
the order of ``KINDS``.  Texts and runs of any length are scanned whole, in linear time.  Repeated
rows get equal results, an empty table gives an empty result; other columns pass through, but one that is named like the result
(``out``) is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the rule: kinds in their order and least characters (of the value for assignments).
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

# runs of one class of characters match whole, so "at least n" in the pattern drops what is shorter
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII).finditer
_access = re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4)).finditer
_hex = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX).finditer

LEAST_RUN = 12
#: By form, the longest first: (characters from which it holds, characters a token that a run must not reach).
LIMITS = {
    "mixed": ((20, 2.2), (16, 2.0), (12, 1.7)),
    "identifier": ((16, 2.0), (12, 1.5)),
    "word": ((20, 1.9), (16, 1.5)),
}
VOCABULARY = "byte_bpe_50k.tiktoken"

_run = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN).finditer
#: Hexadecimal digits of the usual digests (128 to 512 bits).
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
_digest = re.compile(r"[0-9a-f]+|[0-9A-F]+").fullmatch
_uuid = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}").fullmatch
_number = re.compile(r"[0-9/_=+-]+").fullmatch
# no part is given back once it is matched, so this is linear
_identifier = re.compile(r"(?>[_/=+-]*+(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}(?![a-z])|[0-9]{1,4}(?![0-9])))++[_/=+-]*+").fullmatch
_word = re.compile(r"[A-Z]?[a-z]++|[A-Z]++").fullmatch
_separated = re.compile(r"[A-Za-z0-9][_/=+-]+[A-Za-z0-9]").search
_parts = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])").findall


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", *m.span()) for m in _assign(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _access(text)]
    spans += [("hex", *m.span()) for m in _hex(text)]
    return ordered(spans)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def known_form(run: str) -> bool:
    """Whether a run is a digest, a UUID or a number rather than a secret."""
    if len(run) in DIGEST_LENGTHS and _digest(run):
        return True
    return bool(_uuid(run) or _number(run))


def form(run: str) -> str:
    if _word(run.strip("_/=+-")):
        return "word"
    return "identifier" if _identifier(run) else "mixed"


class Scanner:
    """``limits`` by form as ``LIMITS`` has them."""

    def __init__(self, rank_path: str, pattern: str, limits: dict = LIMITS) -> None:
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.limits = limits
        self.least_word = min(n for n, _ in limits["word"])

    def tokens(self, run: str) -> int:
        return len(self.encoding.encode_ordinary(run))

    def random(self, run: str) -> bool:
        """Whether a run of no known form has more tokens than its form allows."""
        kind = form(run)
        parts = [run.strip("_/=+-")] if kind == "word" else _parts(run) if kind == "identifier" and _separated(run) else [run]
        n = len(parts[0]) if kind == "word" else len(run)
        limit = next((most for least, most in self.limits[kind] if n >= least), 0.0)
        # words between signs, each by itself
        return bool(limit and parts) and sum(map(len, parts)) < limit * sum(map(self.tokens, parts))

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans), each by start, then kind."""
        if not text:
            return [], []
        base = base_spans(text)
        more = []
        for m in _run(text):
            start, end = m.span()
            if end - start < self.least_word and m[0].isalpha() and _word(m[0]):
                continue
            if any(s <= start and end <= e for _, s, e in base) or known_form(m[0]):
                continue
            if self.random(m[0]):
                more.append(("random", start, end))
        return base, ordered(base + more) if more else base


def redacted(text: str, spans: list[tuple[str, int, int]], by: str = "[REDACTED]") -> str:
    """The text with every stretch that spans cover, overlapping ones together, replaced by ``by``."""
    out, at = [], 0
    end = -1
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= end:
            out += [text[at:s], by]
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]


def scanner(*key) -> Scanner:
    """The worker's scanner for a rank file and a pattern."""
    return common.model(Scanner, *key)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", out: str = "found") -> DataFrame:
    """Add the struct ``out`` (base, spans): arrays of (kind, start, end)."""

    @F.arrow_udf("base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>")
    def found(col: pa.Array) -> pa.Array:
        s = scanner(rank_path, pattern)
        both = [s.spans(t.as_py()) for t in col]
        cols = [pa.array([[dict(zip(("kind", "start", "end"), x)) for x in b[i]] for b in both], pa.list_(_SPAN)) for i in (0, 1)]
        return pa.StructArray.from_arrays(cols, names=["base", "spans"])

    return docs.withColumn(out, found(common.column(text)))


def redact(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", by: str = "[REDACTED]") -> DataFrame:
    """Replace every span in ``text``; a text without spans, or null, stays as it is."""

    @F.arrow_udf("string")
    def clean(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = scanner(rank_path, pattern)
        for col in cols:
            texts = []
            for t in col:
                t = t.as_py()
                spans = s.spans(t)[1]
                texts.append(redacted(t, spans, by) if spans else t)
            yield pa.array(texts, pa.string())

    return docs.withColumn(text, clean(common.column(text)))
