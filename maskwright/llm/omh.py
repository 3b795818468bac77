"""Order MinHash fingerprints in DataFrame functions.

A text's words (between ASCII white space) give its k-mers, ``K`` words each; a text with fewer words has
one, all its words.  The o-th occurrence of a k-mer in the text is an element of its own, with a
hash of k-mer and o, so repeats count.  For each of ``SKETCHES`` permutations of the hashes, the ``L`` elements that come
first are selected, put in the order they have in the text, and the tuple of their hashes is hashed:
that is one place of the fingerprint.  Two texts agree in a place when they share the
selected k-mers in the same order, so the share of equal places falls with the edit distance,
not only with the overlap of their sets of k-mers.

The permutations are rotations of one hash: permutation b orders elements by (hash - b / ``SKETCHES``) modulo 1,
so its first elements are the next ones after the point b / ``SKETCHES`` on a ring.  All of a
text's elements are sorted once, as longs of 33 bits of hash and 30 bits of position (no string has more words), and every
sketch is read off the sorted array.  Work and memory are in proportion to the text.  Neighbouring places
share elements, so they are not independent: the share of equal places is as true on average as that of independent
permutations, and varies somewhat more.

Neighbours.  ``compare`` needs every document's successor in the order of ids.  Ids are cut into ranges at
approximate quantiles, several ranges per task, and an id that many rows have (a null, say) into several by a hash of the text;
texts are shuffled once, into their ranges, and each range gets a copy of the first document of the next one, so windows
stay within ranges.

Only DataFrame functions are used.  Nulls: a null text is empty; a text without words has the
fingerprint of no elements; a null id sorts first.  Ties: rows of equal ids are ordered by a hash of the text, then the text.
The only document is its own successor.  Texts of any length are read whole.  An empty table gives an empty result.  Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

K = 5
L = 2
SKETCHES = 64
POSITION_BITS = 30
HASH_BITS = 33
#: Id ranges per shuffle partition.
RANGES = 4


def _each(names: list[str], expression: str) -> list[str]:
    return [expression.format(c=c) + f" as {c}" for c in names]


def signatures(df: DataFrame, texts: list[str], keep: list[str], k: int = K, l: int = L, sketches: int = SKETCHES) -> DataFrame:  # noqa: E741
    """``keep`` and, in place of each text column, its signature: ``sketches`` numbers of 16 bits.

    Every step is a projection of its own, so arrays are made once and then read by
    position.  Names of text columns differ from the lambdas' single letters.
    """
    mask = (1 << POSITION_BITS) - 1
    bucket = f"shiftright({{x}}, {POSITION_BITS + HASH_BITS - (sketches.bit_length() - 1)})"
    if sketches & (sketches - 1) or sketches > 1 << 16:
        raise ValueError("the number of sketches is a power of 2")
    word_hash = ", ".join(f"{{c}}[i + {j}]" for j in range(k))
    pack = f"shiftrightunsigned({{h}}, {64 - HASH_BITS}) * {1 << POSITION_BITS}L + {{i}}"
    steps = [
        "array_remove(split(coalesce({c}, ''), '[ \\\\x09-\\\\x0D]+'), '')",
        # sorted elements: hash of the k-mer, then position
        f"sort_array(case when size({{c}}) >= {k} then transform(sequence(0, size({{c}}) - {k}), i -> {pack.format(h=f'xxhash64({word_hash})', i='cast(i as long)')}) "
        f"when size({{c}}) > 0 then array({pack.format(h='xxhash64(concat_ws(chr(32), {c}))', i='0L')}) else cast(array() as array<long>) end)",
    ]
    rows = df
    for step in steps:
        rows = rows.selectExpr(*keep, *_each(texts, step))
    # where each distinct k-mer starts; equal k-mers follow one another in the text's order
    same = f"shiftright({{c}}[i], {POSITION_BITS}) <> shiftright({{c}}[i - 1], {POSITION_BITS})"
    firsts = f"case when size({{c}}) > 0 then filter(sequence(0, size({{c}}) - 1), i -> i = 0 or {same}) else cast(array() as array<int>) end as {{c}}_first"
    rows = rows.selectExpr(*keep, *texts, *(firsts.format(c=c) for c in texts))
    again = pack.format(h=f"xxhash64(shiftright({{c}}[i], {POSITION_BITS}), i - s)", i=f"({{c}}[i] & {mask})")
    numbered = (
        "case when size({c}) = size({c}_first) then {c} else sort_array(flatten(transform({c}_first, (s, j) -> "
        f"transform(sequence(s, if(j + 1 < size({{c}}_first), {{c}}_first[j + 1], size({{c}})) - 1), i -> if(i = s, {{c}}[i], {again}))))) end"
    )
    rows = rows.selectExpr(*keep, *_each(texts, numbered))
    # the first element at or after the start of each sketch's part of the ring
    here, before = bucket.format(x="{c}[i]"), bucket.format(x="{c}[i - 1]")
    starts = f"case when size({{c}}) > 0 then filter(sequence(0, size({{c}}) - 1), i -> i = 0 or {here} <> {before}) else cast(array() as array<int>) end as {{c}}_start"
    rows = rows.selectExpr(*keep, *texts, *(starts.format(c=c) for c in texts))
    at = bucket.format(x="{c}[s]")
    prior = bucket.format(x="{c}[{c}_start[j - 1]]")
    last = bucket.format(x="{c}[element_at({c}_start, -1)]")
    places = (
        "case when size({c}) > 0 then concat(flatten(transform({c}_start, (s, j) -> "
        f"array_repeat(s, cast({at} - if(j = 0, -1L, {prior}) as int)))), array_repeat(0, cast({sketches - 1} - {last} as int))) else cast(array() as array<int>) end as {{c}}_place"
    )
    rows = rows.selectExpr(*keep, *texts, *(places.format(c=c) for c in texts))
    # position on top, so that sorting the few chosen ones gives the text's order
    turn = f"({{e}} & {mask}) * {1 << HASH_BITS}L + shiftright({{e}}, {POSITION_BITS})"
    chosen = f"sort_array(transform(sequence(0, least({l}, size({{c}})) - 1), t -> {turn.format(e='{c}[(p + t) % size({c})]')}))"
    tuples = (
        f"case when size({{c}}) > 0 then transform({{c}}_place, p -> cast(xxhash64(transform({chosen}, x -> x & {(1 << HASH_BITS) - 1}L)) & 65535 as int)) "
        f"else array_repeat(0, {sketches}) end"
    )
    return rows.selectExpr(*keep, *_each(texts, tuples))


def hexadecimal(signature: str) -> Column:
    """A signature as four hexadecimal digits a place."""
    return F.expr(f"concat_ws('', transform({signature}, x -> lower(lpad(hex(x), 4, '0'))))")


def likeness(a: str, b: str) -> Column:
    """The share of equal places of two signatures."""
    return F.expr(f"cast(size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> e)) as double) / size({a})")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how: int) -> DataFrame:
    """(id, signature, fingerprint) of every text."""
    rows = signatures(docs.select(common.column(id_col).alias("__id"), common.column(text).cast("string").alias("__text")), ["__text"], ["__id"], **how)
    return rows.select(F.col("__id").alias(id_col), F.col("__text").alias("signature"), hexadecimal("__text").alias("fingerprint"))


def ranged(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(__id, __key, __hash, __text, __range): ranges follow the order of key and hash."""
    key, body = F.coalesce(common.column(id_col).cast("long"), F.lit(common.FIRST_KEY)), F.coalesce(common.column(text).cast("string"), F.lit(""))
    rows = docs.select(common.column(id_col).cast("long").alias("__id"), key.alias("__key"), F.xxhash64(body).alias("__hash"), body.alias("__text"))
    cuts = common.key_cuts(rows.select("__key"), RANGES * common.shuffle_partitions(docs.sparkSession))
    return rows.withColumn("__range", common.range_of(cuts, "__key", "__hash"))


def compare(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how: int) -> DataFrame:
    """Fingerprint every text and its edited text, and compare it with that and with its successor.

    The edited text has the last quarter of the code points (rounded down) replaced by as many first
    ones of the successor, or all it has; after the last document comes the first.
    """
    spark = docs.sparkSession
    rows = ranged(docs, text, id_col)
    firsts = rows.groupBy("__range").agg(F.min(F.struct("__key", "__hash")).alias("f")).select("__range", "f.*")
    heads = sorted(tuple(r) for r in firsts.collect())  # a row per range
    copies = [{"__key": key, "__hash": hash_, "__to": heads[i - 1][0]} for i, (_, key, hash_) in enumerate(heads)]
    next_heads = common.small_table(spark, copies, "__key:bigint,__hash:bigint,__to:int")
    guests = rows.join(next_heads, ["__key", "__hash"]).groupBy("__key", "__hash", "__to").agg(F.min("__text").alias("__text"))
    own = rows.select("__range", "__id", "__key", "__hash", "__text", F.lit(0).alias("__guest"))
    every = own.union(guests.select(F.col("__to"), F.lit(None).cast("long"), "__key", "__hash", "__text", F.lit(1)))
    over = "over (partition by __range order by __guest, __key, __hash, __text)"
    paired = every.selectExpr("__range", "__id", "__guest", "__text", f"row_number() {over} as __place", f"lead(__text) {over} as __next")
    keep = ["__range", "__id", "__guest", "__place"]
    edited = paired.selectExpr(
        *keep, "length(__text) as n_chars",
        "concat(left(__text, length(__text) - length(__text) div 4), left(coalesce(__next, ''), cast(length(__text) div 4 as int))) as __edited", "__text",
    ).selectExpr(*keep, "cast(n_chars as long) as n_chars", "sha2(__edited, 256) as edited_sha256", "__text", "__edited")
    signed = signatures(edited, ["__text", "__edited"], [*keep, "n_chars", "edited_sha256"], **how)
    # by place, so the successor is the same row as above whatever is equal
    led = signed.selectExpr("*", "lead(__text) over (partition by __range order by __place) as __next").where("__guest = 0")
    return led.select(
        F.col("__id").alias(id_col), "n_chars", "edited_sha256", hexadecimal("__text").alias("fingerprint"), hexadecimal("__edited").alias("edited_fingerprint"),
        likeness("__text", "__edited").alias("near_edited"), likeness("__text", "__next").alias("near_next"),
    )
