"""Named-entity recognition as a plug-in.

A plug-in is a function without arguments that loads a model, and returns a function from a text to
(label, start, end) spans in code points.  It is called once per Python worker, whatever the number of
tasks and queries that the worker serves.  What
follows inference, the map of labels and the suppression inside mail addresses, is
expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import text as t
from maskwright.schema import CANDIDATE

SOURCE = "ginza"
SCORE = 0.82
# The model's labels for each type.
LABELS = {
    "PERSON": ("PERSON", "PER"),
    "ORGANIZATION": ("ORG", "COMPANY", "ORGANIZATION_OTHER", "POLITICAL_ORGANIZATION_OTHER", "PRO_SPORTS_ORGANIZATION", "SHOW_ORGANIZATION", "SCHOOL", "RESEARCH_INSTITUTE", "GOVERNMENT", "INTERNATIONAL_ORGANIZATION"),
    "LOCATION": ("CITY", "PROVINCE", "COUNTRY", "COUNTY", "GPE_OTHER", "LOCATION_OTHER"),
}

Tagger = Callable[[str], list[tuple[str, int, int]]]
Loader = Callable[[], Tagger | None]

#: The worker's models, by a hash of their loaders.
_loaded: dict[str, Tagger | None] = {}


def loaded(key: str, loader: Loader) -> Tagger | None:
    """The worker's model of this key; a model that does not load is not tried again."""
    if key not in _loaded:
        try:
            _loaded[key] = loader()
        except (ImportError, OSError, ValueError):
            _loaded[key] = None
    return _loaded[key]


def available(loader: Loader | None) -> bool:
    """Whether the model loads here; a failure to load means no model, not an error."""
    if loader is None:
        return False
    try:
        return loader() is not None
    except (ImportError, OSError, ValueError):
        return False


def entity_type(label: Column) -> Column:
    """The type of a model's label, or null."""
    pairs = [F.lit(x) for e, labels in LABELS.items() for label_ in labels for x in (label_, e)]
    return F.try_element_at(F.create_map(*pairs), F.replace(F.upper(label), F.lit("-"), F.lit("_")))


def tag(text: Column, loader: Loader) -> Column:
    """What the model finds: array<struct<label,start,end>>; none for blank texts, or if the model does not load."""
    key = hashlib.sha256(cloudpickle.dumps(loader)).hexdigest()

    @F.pandas_udf("array<struct<label:string,start:int,end:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = loaded(key, loader)
        for texts in batches:
            yield pd.Series([[{"label": a, "start": b, "end": c} for a, b, c in tagger(x)] if tagger and x and x.strip() else [] for x in texts])

    return spans(text)


def candidates(text: Column, tagged: Column) -> Column:
    """Candidates for tagged spans of known labels outside mail addresses; ``tagged`` should be a column."""
    typed = F.transform(tagged, lambda s: F.struct(entity_type(s["label"]).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(SCORE).alias("score"), F.lit(SOURCE).alias("source")))
    return F.filter(typed, lambda c: c["entity_type"].isNotNull() & ~t.in_mail_token(text, c["start"], c["end"])).cast(f"array<{CANDIDATE}>")


def gazetteer(names: dict[str, str]) -> Loader:
    """A small tagger that knows names and their labels, for tests and as an example."""

    def load() -> Tagger:
        def tagger(text: str) -> list[tuple[str, int, int]]:
            out = []
            for name, label in names.items():
                at = text.find(name)
                while at >= 0:
                    out.append((label, at, at + len(name)))
                    at = text.find(name, at + len(name))
            return sorted(out, key=lambda x: x[1])

        return tagger

    return load
