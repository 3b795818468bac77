"""Sharding by a k-d tree over document metadata, with shards of nearly equal bytes.

Dimensions are the language (by hash), the size and the text's crc32, so copies of a text lie together
in every dimension.  Each tree node is split along the dimension in which it is widest, in
proportion to the whole table's width, at the weighted median: the place where the bytes on
either side are as the numbers of shards on either side.

A document's place in a dimension is a 62-bit number: the dimension's value, then 32 bits of the
text's hash, so a hot language or size has places to be cut at, and copies of a text have one place.  A cut
falls between places, at the nearer side of the one that holds the median, if that moves no more than ``TOLERANCE`` of a shard's
bytes; else, and only then, that place's group of copies is cut by a hash of ids.  Medians are exact.

Medians of all nodes of a level are found together: bytes are summed in bins
between each node's bounds, a running sum finds the bin that holds the median, and that becomes the
bounds, until the bin is one place.  The nodes' bounds are a small broadcast table, and one row per node comes back to the driver,
so a round's work on the driver is in proportion to the number of shards and never to the corpus; the text is read once.

Shards are numbered in the tree's order.  Slots count from 0 within a shard: salted row numbers plus the
counts of the salts before.  Only DataFrame functions are used.

Nulls: a null text has 0 bytes, hence size 1, and the crc32 of no bytes (0); a null id or language is a
value like any other.  Repeated rows are placed each; rows equal in id and text (ties) lie in one shard.  Texts of any
length count whole.  An empty table gives an empty result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bins of a node in a round, at most and at least, and of all nodes together, about.
BINS, LEAST_BINS, ALL_BINS = 4096, 16, 1 << 20
#: Share of a shard's bytes by which sizes may differ to keep a group of copies whole.
TOLERANCE = 0.01
DIMENSIONS = ("lang", "size", "text_crc32")
#: Levels of the tree after which rows are written with their nodes.
LEVELS = 6
_END = 1 << 62


def measured(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(id, size, text_crc32, p0, p1, p2, tie): what the tree needs of a document, with its place in each dimension."""
    body = F.coalesce(common.column(text).cast("string"), F.lit(""))
    rows = docs.select(
        common.column(id_col).cast("long").alias("id"),
        (F.octet_length(body) + F.lit(1).cast("long")).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.crc32(F.coalesce(common.column(lang).cast("string"), F.lit("")).cast("binary")).alias("lang"),
        F.xxhash64(body).bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"),
    )
    values = (F.shiftright("lang", 2), F.least("size", F.lit(2**30 - 1)), F.shiftright("text_crc32", 2))
    places = [F.shiftleft(v.cast("long"), 32).bitwiseOR(F.col("hash")).alias(f"p{i}") for i, v in enumerate(values)]
    return rows.select("id", "size", "text_crc32", *places, F.shiftrightunsigned(F.xxhash64(F.lit("slot"), "id"), 2).alias("tie"))


def _along(axis: Column) -> Column:
    return F.when(axis == 0, F.col("p0")).when(axis == 1, F.col("p1")).otherwise(F.col("p2"))


_CUT = "at_node:int,axis:int,place:bigint,cut_tie:bigint,child:int"


class Tree:
    """``rows`` have their node of the last stored level; ``cuts`` has the levels since then, ``shards`` the shards of each node now."""

    def __init__(self, rows: DataFrame, shards: int) -> None:
        self.rows = rows.withColumn("node", F.lit(0))
        self.shards = [shards]
        self.cuts: list[list[dict]] = []

    def placed(self) -> DataFrame:
        """The rows with their nodes of the current level."""
        rows = self.rows
        for level in self.cuts:
            own = _along(F.col("axis"))
            right = (own > F.col("place")) | ((own == F.col("place")) & (F.col("tie") >= F.col("cut_tie")))
            joined = rows.join(common.small_table(rows.sparkSession, level, _CUT), F.col("node") == F.col("at_node"))
            rows = joined.select(*(c for c in rows.columns if c != "node"), (F.col("child") + right.cast("int")).alias("node"))
        return rows

    def split(self, cuts: dict[int, tuple[int, int, int]]) -> None:
        """One level more: ``cuts`` has (axis, place, tie) of the nodes that are split; a node without keeps its rows on its left."""
        level, now = [], []
        for n, k in enumerate(self.shards):
            axis, place, tie = cuts.get(n, (0, 2**63 - 1, 0))
            level.append({"at_node": n, "axis": axis, "place": place, "cut_tie": tie, "child": len(now)})
            now += [k // 2, k - k // 2] if k > 1 else [k]
        self.shards = now
        self.cuts.append(level)
        if len(self.cuts) == LEVELS:
            self.rows, self.cuts = common.stored(self.placed(), "shard-nodes"), []


_BOUNDS = "at_node:int,axis:int,fixed:bigint,low:bigint,high:bigint,step:bigint,below:bigint,target:bigint"


def _medians(rows: DataFrame, axis: dict[int, int], target: dict[int, int], low: dict[int, int], high: dict[int, int], slack: float) -> dict[int, tuple[int, int, int]]:
    """Per node (axis, place, tie) of the cut below which lies ``target`` of its bytes, as nearly as groups within ``slack`` allow."""
    cuts: dict[int, tuple[int, int, int]] = {}
    bins = max(LEAST_BINS, min(BINS, ALL_BINS // max(1, len(axis))))
    step_of = lambda span: max(1, -(-span // bins))
    open_ = {n: {"at_node": n, "axis": axis[n], "fixed": -1, "low": low[n], "high": high[n], "step": step_of(high[n] - low[n]), "below": 0, "target": target[n]} for n in axis}
    while open_:
        placed = rows.join(common.small_table(rows.sparkSession, list(open_.values()), _BOUNDS), F.col("node") == F.col("at_node"))
        own = _along(F.col("axis"))
        at = F.when(F.col("fixed") < 0, own).otherwise(F.col("tie"))
        inside = placed.withColumn("at", at).where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")) & ((F.col("fixed") < 0) | (own == F.col("fixed"))))
        sums = inside.groupBy("node", "below", "target", F.expr("(at - low) div step").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        run = sums.selectExpr("*", "below + sum(bytes) over (partition by node order by bin rows between unbounded preceding and current row) as run")
        for r in run.where("run >= target and run - bytes < target").collect():  # at most a row per node
            b = open_.pop(r["node"])
            start = b["low"] + r["bin"] * b["step"]
            end = min(b["high"], start + b["step"])
            before, after = b["target"] - (r["run"] - r["bytes"]), r["run"] - b["target"]
            edge = start if before < after else end
            if r["rows"] == 1 or (b["step"] == 1 and (b["fixed"] >= 0 or min(before, after) <= slack)):
                cuts[b["at_node"]] = (b["axis"], b["fixed"], edge) if b["fixed"] >= 0 else (b["axis"], edge, 0)
            elif b["step"] == 1:  # a group of copies that is too large for either side
                open_[b["at_node"]] = b | {"fixed": start, "low": 0, "high": _END, "step": step_of(_END), "below": r["run"] - r["bytes"]}
            else:
                # few rows have few places, wherever they are
                open_[b["at_node"]] = b | {"low": start, "high": end, "step": 1 if r["rows"] <= bins else step_of(end - start), "below": r["run"] - r["bytes"]}
    return cuts


def grow(rows: DataFrame, shards: int) -> Tree:
    """Split ``rows`` (stored: they are read a few times per level) into ``shards`` leaves."""
    tree = Tree(rows, shards)
    whole: list[int] | None = None
    slack = 0.0
    while max(tree.shards) > 1:
        placed = tree.placed()
        ranges = [f(F.shiftright(f"p{i}", 32)).alias(f"{name}{i}") for i in range(len(DIMENSIONS)) for name, f in (("low", F.min), ("high", F.max))]
        found = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("bytes"), *ranges).collect()}  # a row per node
        if not found:
            return Tree(rows, 1)
        spans = {n: [r[f"high{i}"] - r[f"low{i}"] for i in range(len(DIMENSIONS))] for n, r in found.items()}
        if whole is None:
            whole, slack = spans[0], TOLERANCE * found[0]["bytes"] / shards
        split = [n for n in found if tree.shards[n] > 1]
        axis = {n: max(range(len(DIMENSIONS)), key=lambda i: (spans[n][i] / whole[i] if whole[i] else 0.0, -i)) for n in split}
        low = {n: found[n][f"low{axis[n]}"] << 32 for n in split}
        high = {n: (found[n][f"high{axis[n]}"] + 1) << 32 for n in split}
        target = {n: max(1, found[n]["bytes"] * (tree.shards[n] // 2) // tree.shards[n]) for n in split}
        tree.split(_medians(placed, axis, target, low, high, slack))
    return tree


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(id, size, text_crc32, shard, slot): into ``shards`` shards, or as many as ``target_bytes`` asks for."""
    rows = common.stored(measured(docs, text, id_col, lang), "shard-rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if shards is None:
        shards = max(1, -(-(total or 0) // target_bytes))
    placed = grow(rows, shards).placed().select("id", "size", "text_crc32", F.col("node").alias("shard"))
    slots = common.numbered(placed, "shard", ["id", "text_crc32"], "slot", n)
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
