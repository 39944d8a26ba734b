"""Extractors as a table function of SQL: ``SELECT * FROM extract_fields(TABLE(docs), 'labels-v1', 'due_date,vat_number')``.

The function is polymorphic: its columns are those of the table that it's given, and raw_<field> and conf_<field> of the fields that are asked for. An
extractor is a function from (text, doc_type) to {field: (raw, confidence)}; it's looked up by name when the query is analysed and
sent to the tasks, so a model or a rule in Python is usable from SQL like rules-v1 from DataFrames. Rows are taken one at a time and in parallel;
no row is moved.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import patterns as P

Found = dict[str, tuple[str, float]]
Extractor = Callable[[str, str], Found]

#: The fields that a table of labels decides alone, each with the table, the flags of its patterns, and whether a value needs a digit.
LABELS = {
    "invoice_date": (P.INVOICE_DATE, P.INVOICE_DATE_FLAGS, False),
    "due_date": (P.DUE_DATE, {}, False),
    "vat_number": (P.VAT_NUMBER, P.VAT_FLAGS, False),
    "purchase_order_number": (P.PO_NUMBER, {}, True),
}
_compiled: dict[str, list[tuple[re.Pattern, float]]] = {}


def _patterns(field: str) -> list[tuple[re.Pattern, float]]:
    """A field's patterns, compiled once a process."""
    if field not in _compiled:
        table, flags, _ = LABELS[field]
        modes = [(flags or {}).get(i, "(?iUd)") for i in range(len(table))]
        modes = [(re.IGNORECASE if "i" in m else 0) | (re.MULTILINE if "m" in m else 0) for m in modes]
        _compiled[field] = [(re.compile(f"(?:{label})({value})(?:{tail})", mode), c) for (label, value, tail, c), mode in zip(table, modes, strict=True)]
    return _compiled[field]


def by_labels(text: str, doc_type: str) -> Found:
    """The fields of LABELS by the same patterns as rules-v1, in Python."""
    out: Found = {}
    for field, (_, _, digit) in LABELS.items():
        for pattern, confidence in _patterns(field):
            m = pattern.search(text)
            raw = m.group(1).strip() if m else ""
            if raw:
                if not digit or re.search(r"\d", raw):
                    out[field] = (raw, confidence)
                break
    return out


_extractors: dict[str, Extractor] = {"labels-v1": by_labels}


@dataclass
class Chosen(AnalyzeResult):
    """What analysis hands to the tasks: the extractor itself, pickled, so that they need no registry."""

    fields: tuple[str, ...] = ()
    extractor: bytes = b""


def _analyzed(known: dict[str, Extractor], table: AnalyzeArgument, extractor: AnalyzeArgument, fields: AnalyzeArgument) -> Chosen:
    if not table.isTable or not {"text", "doc_type"} <= set(table.dataType.names):
        raise ValueError("extract_fields takes a table with columns text and doc_type")
    if extractor.value not in known:
        raise ValueError(f"no extractor {extractor.value!r}; there are {sorted(known)}")
    names = tuple(f.strip() for f in fields.value.split(","))
    new = [T.StructField(f"{p}_{f}", t) for f in names for p, t in (("raw", T.StringType()), ("conf", T.DoubleType()))]
    return Chosen(schema=T.StructType([*table.dataType.fields, *new]), fields=names, extractor=cloudpickle.dumps(known[extractor.value]))


class ExtractFields:
    """The table has columns text and doc_type; a null text is empty. A field that isn't found, or that the extractor doesn't know, is null."""

    def __init__(self, chosen: Chosen) -> None:
        self.fields, self.extract = chosen.fields, pickle.loads(chosen.extractor)

    def eval(self, row: Row, extractor: str, fields: str) -> Iterator[tuple]:  # noqa: ARG002
        found = self.extract(row["text"] or "", row["doc_type"])
        yield (*row, *(x for f in self.fields for x in found.get(f, (None, None))))


def register(spark: SparkSession, extractors: dict[str, Extractor] | None = None) -> None:
    """Make ``extract_fields`` known to the session's SQL, with more extractors by name.

    Analysis runs in a process of its own, so the registry goes there inside the class."""
    _extractors.update(extractors or {})
    known = dict(_extractors)

    class Known(ExtractFields):
        @staticmethod
        def analyze(table: AnalyzeArgument, extractor: AnalyzeArgument, fields: AnalyzeArgument) -> Chosen:
            return _analyzed(known, table, extractor, fields)

    spark.udtf.register("extract_fields", udtf(Known))
