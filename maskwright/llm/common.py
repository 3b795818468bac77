"""What the operators of this package share: tables, shared storage, words, batches."""

from __future__ import annotations

import atexit
import ctypes
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute known
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` has it.
BLANKS = " \t\n\x0b\x0c\r"
#: Where a session names no shared folder: the one made for it, by application.
_own: dict[str, str] = {}
#: Paths that this process has written and not removed.
_made: list[str] = []
#: Rows that one task numbers, about.
ROWS_PER_SALT = 200_000
#: Rows are handed to Python in slices of about this many bytes of text.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; where that is unset, one of our own.

    An own folder is machine-local and therefore only right for a local master;
    on any other master the warehouse is used.
    """
    application = spark.sparkContext.applicationId
    path = spark.conf.get("spark.checkpoint.dir", None) or _own.get(application)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        path = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, path, True)
    else:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    _own[application] = path
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; what is there goes when this process ends, if Spark still runs."""
    if not _made:
        atexit.register(_remove_made)
    _made.append(f"{shared_dir(spark)}/maskwright/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _remove_made() -> None:
    spark = SparkSession.getActiveSession()
    try:
        while spark and _made:
            _remove(spark, _made.pop())
    except Exception:  # the JVM may be gone before this process; the folder is then left to its owner
        return


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage.

    A lost executor then costs a task of the readers, never the work before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.options(**options).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_path = path  # type: ignore[attr-defined]
    return out


def forget(df: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing reads it any more."""
    path = getattr(df, "stored_path", None)
    if path:
        _remove(df.sparkSession, path)
        _made.remove(path)


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What is stored within this goes at its end, but for the frames that are put into the list: a result may read them."""
    before, kept = set(_made), []
    yield kept
    for path in [p for p in _made if p not in before and p not in {getattr(df, "stored_path", None) for df in kept}]:
        _remove(spark, path)
        _made.remove(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of ``column``, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.binary_length(col).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Within this, what is run hands Python at most so many rows at once: for rows that are whole texts or sets of hashes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_models: dict[tuple, object] = {}


def model(make: Callable | None, *key):
    """The worker's ``make(*key)``.  A worker has one at a time: those that earlier queries or stages left go, all of them if ``make`` is None."""
    own = (make, *key)
    if own not in _models:
        if _models:
            _models.clear()
            release()
        if make is None:
            return None
        _models[own] = make(*key)
    return _models[own]


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to about ``limit`` bytes of ``column``; larger ones are passed on as they are."""
    held, size = [], 0
    for batch in batches:
        own = pa.compute.sum(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)))).as_py() or 0
        if held and size + own > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


def release() -> None:
    """A worker lives on for other tasks and queries: memory that this task has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space (``bytes.split`` knows exactly those six characters)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def small_table(spark: SparkSession, values: list[dict], schema: str) -> DataFrame:
    """A table of a few rows made in the JVM, marked for broadcasting."""
    one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")).alias("t"))
    return F.broadcast(one.select("t.*"))


#: The key of a null id: before all others.
FIRST_KEY = -(2**63)


def key_cuts(keys: DataFrame, count: int) -> list[int]:
    """At most ``count`` - 1 values that cut the longs of the one column into ranges of nearly as many rows; a frequent value is there more than once."""
    wanted = [i / count for i in range(1, count)]
    (cuts,) = keys.agg(F.percentile_approx(keys.columns[0], wanted, max(10_000, 20 * count))).first()
    return cuts or []


def range_of(cuts: list[int], key: str, hash_: str) -> Column:
    """The row's range, by binary search for its key among the cuts; rows of a key that several cuts have are dealt by their hash.

    Ranges follow the order of (key, hash), so a key that many rows have is as many ranges as its share asks for.
    """
    if not cuts:
        return F.lit(0)
    array = "array(" + ", ".join(f"{c}L" if c > FIRST_KEY else f"cast('{c}' as long)" for c in cuts) + ")"

    def search(test: str) -> str:
        step = (
            f"if(a.low < a.high, if(cuts[(a.low + a.high) div 2] {test} `{key}`, named_struct('low', cast((a.low + a.high) div 2 as int) + 1, 'high', a.high), "
            "named_struct('low', a.low, 'high', cast((a.low + a.high) div 2 as int))), a)"
        )
        return f"aggregate(sequence(1, {len(cuts).bit_length() + 1}), named_struct('low', 0, 'high', {len(cuts)}), (a, s) -> {step}, a -> a.low)"

    both = F.expr(f"transform(array({array}), cuts -> named_struct('a', {search('<')}, 'b', {search('<=')}))[0]")
    equal = both["b"] - both["a"]
    part = F.floor((F.col(hash_).cast("double") / F.lit(2.0**64) + 0.5) * (equal + 1)).cast("int")
    return F.when(equal > 0, both["a"] + F.least(part, equal)).otherwise(both["a"])


def spread(*cols: Column, into: int) -> Column:
    """A salt from 0 to ``into`` - 1 that depends on the row's values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(into)).cast("int")


def numbered(rows: DataFrame, group: str, order: list[str], name: str, total: int) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within each value of ``group``, whatever its share of the rows.

    Rows are dealt to salts by their values; a salt's rows are numbered in one task, and
    the counts of the salts before are added.  Equal rows may swap numbers, which shows nowhere.
    """
    salts = max(64, -(-total // ROWS_PER_SALT))
    salted = rows.withColumn("__salt", spread(*order, into=salts))
    counts = salted.groupBy(group, "__salt").agg(F.count("*").alias("__n"))
    before = counts.selectExpr(group, "__salt", f"coalesce(sum(__n) over (partition by {group} order by __salt rows between unbounded preceding and 1 preceding), 0) as __before")
    ranked = salted.selectExpr("*", f"row_number() over (partition by {group}, __salt order by {', '.join(order)}) - 1 as __rank")
    return ranked.join(before, [group, "__salt"]).withColumn(name, F.col("__rank") + F.col("__before")).drop("__salt", "__rank", "__before")


def hash_share(share: float) -> int:
    """The limit below which this share of all signed 64-bit hashes lies."""
    return min(int(share * 2**64) - 2**63, 2**63 - 1)
