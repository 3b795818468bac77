"""Text expressions on code points: offsets are 0-based, the end is not included.

No expression here leaves the JVM.  Java's ``regexp_instr`` counts UTF-16 units, so places of matches are
found in another way: matches are put between two private-use characters and the text is split there;
the lengths of the pieces, in code points, are the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.schema import SPAN

OPEN, CLOSE, OTHER = "", "", ""
#: Java flags that make a pattern behave as in Python: ``.`` and ``$`` mind line feeds only, classes are Unicode.
PYTHON_FLAGS = "(?dU)"
PYTHON_FLAGS_ANY_CASE = "(?dUiu)"

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
# Hyphens and dashes that count as "-", and the wide blank.
_DASHES = "‐‑‒–—―−"
_SPACE = "　"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A view for detection, character for character as long as the text: wide forms narrow, dashes plain.

    The two marks become another private-use character, so they can serve as marks.
    """
    return F.translate(text, _WIDE + _DASHES + _SPACE + OPEN + CLOSE, _NARROW + "-" * len(_DASHES) + " " + OTHER + OTHER)


def unmarked(text: Column) -> Column:
    """The text without marks of its own, as long as before."""
    return F.translate(text, OPEN + CLOSE, OTHER + OTHER)


def spans_between_marks(marked: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(a: Column, piece: Column) -> Column:
        end = a["at"] + F.length(piece)
        span = F.struct(a["at"].alias("start"), end.alias("end"), piece.alias("text"))
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), F.when(a["inside"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.split(marked, f"[{OPEN}{CLOSE}]", -1), start, step, lambda a: a["out"])


def mark_spans(text: Column, pattern: str | Column, group: int = 0, guard: Column | None = None) -> Column:
    """All matches of a Java pattern as array<struct<start,end,text>>.

    With ``group`` 2, the pattern is (what comes before)(the span) and only the span is marked.  Texts that
    ``guard`` denies, or that have no match, cost no splitting.
    """
    by = f"$1{OPEN}$2{CLOSE}" if group == 2 else f"{OPEN}$0{CLOSE}"
    marked = F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(by))
    none = F.array().cast(f"array<{SPAN}>")
    # bound once: the marked text is tested and split
    found = F.element_at(F.transform(F.array(marked), lambda m: F.when(F.contains(m, F.lit(OPEN)), spans_between_marks(m)).otherwise(none)), 1)
    return F.when(guard, found).otherwise(none) if guard is not None else found


def one_row_each(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """``keep`` and ``name``: a row per element of an array.

    A plain explode makes the optimiser test the array's size first, below the projections that make it, so that
    all of detection would run twice; an outer one does not, and the rows without an element go afterwards.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def piece(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def before(text: Column, start: Column, count: int) -> Column:
    """Up to ``count`` code points before ``start``."""
    return F.substring(text, F.greatest(start - count, F.lit(0)) + 1, F.least(start, F.lit(count)))


def around(text: Column, start: Column, end: Column, left: int, right: int) -> Column:
    first = F.greatest(start - left, F.lit(0))
    return F.substring(text, first + 1, end - first + right)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def leading_blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+", ""))


def ascii_key(text: Column) -> Column:
    """For comparing without regard to the case of A-Z, and of nothing else."""
    return F.translate(text, UPPER, LOWER)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


#: All Unicode decimal digits' zeros in the basic plane, for checks that count in ASCII.
_ZEROS = [c for c in range(0x30, 0xFFFF) if not 0xD800 <= c < 0xE000 and chr(c).isdecimal() and int(chr(c)) == 0]


def ascii_digits(text: Column) -> Column:
    source = "".join(chr(z + i) for z in _ZEROS for i in range(10))
    return F.translate(text, source, "0123456789" * len(_ZEROS))


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _ip_pattern() -> str:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = rf"(?:{octet}\.){{3}}{octet}"
    h = "[0-9A-Fa-f]{1,4}"
    forms = [v4, f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{v4}"]
    for left in range(8):
        head = f"{h}(?::{h}){{{left - 1}}}" if left else ""
        right = 7 - left
        forms.append(f"{head}::" + (f"(?:{h}(?::{h}){{0,{right - 1}}})?" if right else ""))
        if right >= 2:
            forms.append(f"{head}::(?:{h}:){{0,{right - 2}}}{v4}")
    return "^(?:" + "|".join(forms) + ")$"


#: Every textual form of an IPv4 or IPv6 address, built from the address grammar.
IP_PATTERN = _ip_pattern()


def is_ip(text: Column) -> Column:
    return text.rlike(IP_PATTERN)


#: Characters that an address of mail may have around its parts.
MAIL_CHARACTERS = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~@-]"


def in_mail_token(text: Column, start: Column, end: Column) -> Column:
    """Whether the span, grown over mail characters on both sides, has an @."""
    left = F.regexp_extract(F.substring(text, F.lit(1), start), f"{MAIL_CHARACTERS}*$", 0)
    right = F.regexp_extract(F.substring(text, end + 1, F.length(text)), f"^{MAIL_CHARACTERS}*", 0)
    return F.contains(F.concat(left, piece(text, start, end), right), F.lit("@"))


def full_width(text: Column) -> Column:
    return F.translate(text, "0123456789-", "０１２３４５６７８９－")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def finding_id(block: Column, start: Column, end: Column, entity_type: Column) -> Column:
    """The first 20 hexadecimal digits of the sha256 of block:start:end:type."""
    return F.substring(F.sha2(F.concat_ws(":", block, start, end, entity_type), 256), 1, 20)


def download_name(path: Column) -> Column:
    """A safe file name of at most 180 characters; ``document`` if nothing is left."""
    base = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0)
    safe = F.substring(F.regexp_replace(base, r"(?U)[^\w.()\-　-ヿ㐀-鿿]", "_"), 1, 180)
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("document"))


def entity_list(csv: str | None) -> list[str] | None:
    """Comma-separated entity types; empty parts go, nothing left means all."""
    return [x for x in (csv or "").split(",") if x] or None
