"""The functions of this package for SQL users, as SQL functions of the session: ``mw_...``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from maskwright.functions import text as t


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """Define the functions.  They are expressions, so plans that use them stay in the JVM."""
    source = t._WIDE + t._DASHES + t._SPACE + t.OPEN + t.CLOSE
    target = t._NARROW + "-" * len(t._DASHES) + " " + t.OTHER * 2
    define = "create or replace temporary function "
    spark.sql(f"{define} mw_normalise(s string) returns string return translate(s, {_quoted(source)}, {_quoted(target)})")
    spark.sql(f"{define} mw_is_ip(s string) returns boolean return s rlike {_quoted(t.IP_PATTERN)}")
    spark.sql(f"{define} mw_luhn(s string) returns boolean return luhn_check(s)")
    spark.sql(f"{define} mw_finding_id(block string, a int, b int, kind string) returns string return substring(sha2(concat_ws(':', block, a, b, kind), 256), 1, 20)")
    spark.sql(
        f"{define} mw_mask(s string, spans array<struct<start:int,end:int>>, mark string) returns string "
        "return aggregate(reverse(array_sort(spans)), s, (t, x) -> if(x.start >= 0 and x.end <= length(s) and x.end > x.start, concat(substring(t, 1, x.start), repeat(mark, x.end - x.start), substring(t, x.end + 1)), t))"
    )


def findings_view(spark: SparkSession, table: str, view: str, engine=None, text: str = "text", block: str = "block_id") -> None:
    """A temporary view of the findings in a table's or view's texts, computed when it is read."""
    from maskwright.plans.engine import Engine

    (engine or Engine()).findings(spark.table(table), text, block).createOrReplaceTempView(view)
