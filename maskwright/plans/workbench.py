"""The review of documents, as calls: analyse into a session, add and remove findings, mask.

Everything that a call returns or keeps is a DataFrame in the session's folder; ids of findings that a reviewer has
accepted come as a list, as they do from a form.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import dictionary as dictionary_
from maskwright.operators import manual, mask
from maskwright.plans.engine import Engine, merged
from maskwright.schema import InvalidInput, NotFound, Unsupported, entity_catalogue
from maskwright.sources import documents


@dataclass
class Workbench:
    spark: SparkSession
    root: str
    engine: Engine = field(default_factory=Engine)

    def __post_init__(self) -> None:
        self.sessions = documents.Sessions(self.spark, f"{self.root}/sessions")
        self.dictionary = dictionary_.Dictionary(self.spark, f"{self.root}/dictionary")

    def info(self) -> dict:
        return self.engine.info()

    def entities(self) -> DataFrame:
        return entity_catalogue(self.spark)

    def _engine(self, entities: tuple[str, ...] | None) -> Engine:
        return Engine(entities or self.engine.entities, self.dictionary.frame(), self.engine.profile, self.engine.tagger)

    def analyze_text(self, text: str, entities: tuple[str, ...] | None = None) -> DataFrame:
        """Findings of one text, whose block is ``text``."""
        block = self.spark.createDataFrame([("text", text)], "block_id string, text string")
        return self._engine(entities).findings(block)

    def mask_text(self, text: str, findings: DataFrame, accepted: list[str], mode: str = "character", character: str = mask.DEFAULT_CHARACTER) -> str:
        listed = findings.agg(F.collect_list(F.struct(*findings.columns)).alias("findings")).withColumn("text", F.lit(text)).withColumn("ids", F.array(*map(F.lit, accepted)).cast("array<string>"))
        return self.engine.mask(listed, accepted="ids", mode=mode, character=character).first()["masked"]

    def analyze_document(self, path: str, entities: tuple[str, ...] | None = None) -> str:
        """Read a file, keep its blocks and findings; returns the session's id."""
        documents.require_supported(path)
        files = documents.read_files(self.spark, path)
        blocks = documents.blocks(files).persist()
        problem = blocks.where("problem is not null").select("problem").limit(1).collect()
        if problem:
            kind = InvalidInput if problem[0]["problem"].startswith("corrupt") else Unsupported
            raise kind(problem[0]["problem"])
        session = self.sessions.new_id()
        kept = blocks.select("path", "block_id", "seq", "text")
        self.sessions.save(session, kept, self._engine(entities).findings(kept))
        blocks.unpersist()
        return session

    def load(self, session: str) -> tuple[DataFrame, DataFrame]:
        return self.sessions.load(session)

    def add_finding(self, session: str, selection: manual.Selection) -> manual.Added:
        blocks, found = self.sessions.load(session)
        added = manual.add(blocks, found, selection, self.dictionary)
        self.sessions.replace(session, merged(found, added.findings))
        return added

    def remove_finding(self, session: str, finding_id: str) -> None:
        self.sessions.replace(session, manual.remove(self.sessions.load(session)[1], finding_id))

    def mask_document(self, session: str, path: str, accepted: list[str], character: str = mask.DEFAULT_CHARACTER) -> tuple[str, bytes]:
        """(name, content) of the file with the accepted findings masked; ids that the session does not know are left out."""
        _, found = self.sessions.load(session)
        files = documents.read_files(self.spark, path)
        first = files.select("path").limit(1).collect()
        if not first:
            raise NotFound("no such file")
        chosen = found.where(F.col("id").isin(accepted)).select(F.lit(first[0]["path"]).alias("path"), "block_id", "start", "end")
        row = documents.masked_files(files, chosen, character).first()
        return row["name"], bytes(row["content"])
