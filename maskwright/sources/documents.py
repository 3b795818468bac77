"""Documents as tables: files to blocks, findings to masked files, sessions, gold sets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text as t
from maskwright.operators import mask
from maskwright.schema import FINDING, MAX_UPLOAD_BYTES, SAMPLE, InvalidInput, NotFound, Unsupported, struct_type

from . import office, pdf

READERS = {".docx": office.read_docx, ".pptx": office.read_pptx, ".pdf": pdf.read_pdf}
WRITERS = {".docx": office.rewrite_docx, ".pptx": office.rewrite_pptx, ".pdf": pdf.rewrite_pdf}
SESSION_ID = "^[0-9a-f]{32}$"


def suffix(path):
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, extension, problem): files with what keeps them from being read, checked in order.

    Spark's reader leaves empty files out itself.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return checked_files(files)


def checked_files(files: DataFrame) -> DataFrame:
    rows = files.withColumn("extension", suffix(F.col("path")))
    problem = (
        F.when(~F.col("extension").isin(*READERS), "unsupported format")
        .when(F.col("length") > MAX_UPLOAD_BYTES, "too large")
        .when(F.col("length") == 0, "empty")
    )
    return rows.withColumn("problem", problem)


def blocks(files: DataFrame) -> DataFrame:
    """(path, block_id, seq, text, problem): blocks in document order; a file that cannot be read is one row with its problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, extension, problem in zip(batch["path"], batch["content"], batch["extension"], batch["problem"]):
                found: list = []
                if problem is None:
                    try:
                        found = READERS[extension](bytes(content))
                    except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, OSError) as e:
                        problem = f"corrupt: {type(e).__name__}"
                if problem is not None:
                    yield pd.DataFrame({"path": [path], "block_id": [None], "seq": [None], "text": [None], "problem": [problem]})
                elif found:
                    yield pd.DataFrame({"path": path, "block_id": [b for b, _ in found], "seq": range(len(found)), "text": [x for _, x in found], "problem": None})

    return files.select("path", "content", "extension", "problem").mapInPandas(run, "path string, block_id string, seq int, text string, problem string")


def masked_files(files: DataFrame, findings: DataFrame, character: str = mask.DEFAULT_CHARACTER) -> DataFrame:
    """(path, name, content): files with their accepted findings (path, block_id, start, end, ...) masked; PDF takes ``*`` whatever is asked."""
    if len(character) != 1:
        raise InvalidInput("the mask is one character")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, name, content, extension, spans in zip(batch["path"], batch["name"], batch["content"], batch["extension"], batch["spans"]):
                by_block: dict[str, list] = {}
                for s in spans if spans is not None else ():
                    by_block.setdefault(s["block_id"], []).append((s["start"], s["end"]))
                mark = mask.PDF_CHARACTER if extension == ".pdf" else character

                def rewrite(block: str, text: str) -> str | None:
                    if block not in by_block:
                        return None
                    for start, end in sorted(by_block[block], reverse=True):
                        if 0 <= start < end <= len(text):
                            text = text[:start] + mark * (end - start) + text[end:]
                    return text

                yield pd.DataFrame({"path": [path], "name": [name], "content": [WRITERS[extension](bytes(content), rewrite)]})

    grouped = findings.groupBy("path").agg(F.collect_list(F.struct("block_id", "start", "end")).alias("spans"))
    rows = files.where(F.col("problem").isNull()).join(grouped, "path", "left")
    named = rows.select("path", F.concat(F.lit("masked_"), t.download_name(F.col("path"))).alias("name"), "content", "extension", "spans")
    return named.mapInPandas(run, "path string, name string, content binary")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold set of JSON lines; blank lines and lines that start with # do not count.

    Any fault raises an error that names the line; so do an id that occurs twice and a set without samples.
    """
    lines = spark.read.text(path).where((t.strip(F.col("value")) != "") & ~t.strip(F.col("value")).startswith("#"))
    parsed = lines.select("value", F.from_json("value", struct_type(SAMPLE), {"mode": "PERMISSIVE"}).alias("s"))
    rows = parsed.select("value", "s.*").withColumns({c: F.coalesce(c, F.lit(d)) for c, d in (("language", "ja"), ("split", "test"), ("source", "synthetic"), ("notes", ""))})
    empty = {c: F.coalesce(c, F.array().cast(struct_type(SAMPLE)[c].dataType)) for c in ("entities", "dictionary_terms", "tags")}
    rows = rows.withColumns(empty)
    rows = rows.withColumn("problem", sample_problem())
    bad = rows.where("problem is not null").select("value", "problem").limit(1).collect()
    if bad:
        raise InvalidInput(f"{path}:{_line_of(spark, path, bad[0]['value'])}: {bad[0]['problem']}")
    twice = rows.groupBy("id").count().where("count > 1").select("id").limit(1).collect()
    if twice:
        raise InvalidInput(f"{path}: duplicate sample id {twice[0]['id']!r}")
    if rows.isEmpty():
        raise InvalidInput(f"{path}: no samples")
    return rows.drop("value", "problem")


def sample_problem():
    """What is wrong with a sample, or null."""
    outside = F.exists("entities", lambda e: (e["start"] < 0) | (e["end"] > F.length("text")) | (e["end"] <= 0))
    differs = F.exists("entities", lambda e: t.piece(F.col("text"), e["start"], e["end"]) != e["text"])
    keys = F.transform("entities", lambda e: F.struct(e["start"], e["end"], e["entity_type"]))
    return (
        F.when(F.col("id").isNull() | F.col("text").isNull(), "not a sample")
        .when(~F.col("split").isin("train", "dev", "test") | ~F.col("source").isin("synthetic", "licensed", "internal"), "unknown split or source")
        .when(outside, "a span is outside the text")
        .when(differs, "a span's text differs")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "a span occurs twice")
    )


def _line_of(spark: SparkSession, path: str, value: str) -> int | str:
    """The number of a line; only looked for when there is an error to tell."""
    numbered = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n", -1))).where(F.col("col") == value)
    row = numbered.limit(1).collect()
    return row[0]["pos"] + 1 if row else "?"


def write_report(report: dict, path: str | None = None) -> str:
    """A report as JSON, written to a driver's file if one is named."""
    text = json.dumps(report, ensure_ascii=False, indent=2) + "\n"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


class Sessions:
    """Analyses kept in Parquet folders by session: blocks and findings, written anew by each change."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._versions: dict[str, int] = {}

    @staticmethod
    def new_id() -> str:
        return uuid.uuid4().hex

    def _path(self, session: str, what: str) -> str:
        import re

        if not re.match(SESSION_ID, session):
            raise NotFound("no such session")
        return f"{self.root}/{session}/{what}"

    def _number(self, session: str) -> int:
        if session not in self._versions:
            jvm = self.spark._jvm
            root = jvm.org.apache.hadoop.fs.Path(self._path(session, ""))
            fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            if not fs.exists(root):
                raise NotFound("no such session")
            names = [s.getPath().getName() for s in fs.listStatus(root)]
            done = [int(n[9:]) for n in names if n.startswith("findings-") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
            self._versions[session] = max(done)
        return self._versions[session]

    def save(self, session: str, blocks_: DataFrame, findings: DataFrame) -> None:
        blocks_.write.parquet(self._path(session, "blocks"))
        findings.write.parquet(self._path(session, "findings-0"))
        self._versions[session] = 0

    def load(self, session: str) -> tuple[DataFrame, DataFrame]:
        number = self._number(session)
        read = self.spark.read
        return read.parquet(self._path(session, "blocks")), read.parquet(self._path(session, f"findings-{number}"))

    def replace(self, session: str, findings: DataFrame) -> None:
        number = self._number(session) + 1
        findings.write.parquet(self._path(session, f"findings-{number}"))
        self._versions[session] = number


FINDING_FIELDS = FINDING[len("struct<") : -1]


def require_supported(path: str) -> None:
    if not any(path.lower().endswith(s) for s in READERS):
        raise Unsupported("unsupported format")
