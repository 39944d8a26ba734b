"""File names and destinations of documents by a policy's template and rules, as columns."""

from __future__ import annotations

import re
import string as _string
import unicodedata
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policy import Category, Naming
from .patterns import TRANSLITERATED
from .text import let


def _decomposed() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to an ASCII letter and marks, and those letters."""
    out = {chr(i): d[0] for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(d := unicodedata.normalize("NFD", chr(i))) > 1 and d[0].isascii() and all(unicodedata.category(c) == "Mn" for c in d[1:])}
    out |= dict(zip(*TRANSLITERATED, strict=True))
    return "".join(out), "".join(out.values())


def slug(c: Column, max_length: int, unsafe: str) -> Column:
    """Free text as a part of a file name."""
    a, b = _decomposed()
    c = F.regexp_replace(F.translate(F.lower(c), a, b), "\\p{Mn}", "")
    c = F.regexp_replace(F.regexp_replace(c, unsafe, "_"), "(?U)[\\s,;]+", "_")
    c = F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^[_.\\-]+|[_.\\-]+$", "")
    return F.substring(c, 1, max_length) if max_length else c


def reserved(stem: Column, names: list[str]) -> Column:
    up = F.upper(stem)
    out = F.lit(False)
    for n in names:
        out = out | (up == n.upper()) | up.startswith(n.upper() + ".")
    return out


def file_name(policy: Naming, fields: dict[str, Column], extension: Column) -> Column:
    """The name before any collision is looked at. ``fields`` has invoice_date, organization_name, document_type and
    invoice_number as text; null stands for a missing one."""
    text = lambda k, default="": F.coalesce(fields.get(k, F.lit(None)).cast("string"), F.lit(default))
    org = slug(text("organization_name", "unknown"), policy.component_max_length, policy.unsafe_chars)
    values = {
        "invoice_date": text("invoice_date"),
        "organization_slug": let(org, lambda x: F.when(x == "", "unknown").otherwise(x)),
        "document_type": text("document_type", "invoice"),
        "invoice_number": slug(text("invoice_number"), policy.component_max_length, policy.unsafe_chars),
        "extension": F.regexp_replace(extension, "^\\.+", ""),
    }
    parts: list[Column] = []
    for literal, name, _, _ in _string.Formatter().parse(policy.template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in values:
                raise ValueError(f"the template has an unknown variable {name!r}")
            parts.append(values[name])
    name = F.regexp_replace(F.regexp_replace(F.concat(*parts), policy.unsafe_chars, "_"), "_+", "_")
    return let(name, lambda x: _bounded(policy, x))


def _bounded(policy: Naming, name: Column) -> Column:
    """A name whose stem is cut to the policy's length, its extension kept, and that is marked if it is reserved."""
    ext = F.regexp_extract(name, "(\\.[^.]*)$", 1)
    stem = F.substring(F.regexp_replace(name, "\\.[^.]*$", ""), F.lit(1), F.greatest(F.lit(policy.max_length) - F.length(ext), F.lit(0)))
    return let(stem, lambda x: F.concat(F.when(reserved(x, list(policy.reserved_names)), "_").otherwise(""), x, ext))


def resolve_collisions(df: DataFrame, existing: DataFrame, policy: Naming, name: str = "name", content_hash: str = "content_hash") -> DataFrame:
    """``df`` with its names changed by the policy where ``existing`` (name) has them, and a flag ``collides``.

    Both sides are only shuffled by name; 'fail' leaves the name and the flag for the caller to act upon."""
    taken = existing.select(F.col("name").alias("_taken")).distinct()
    out = df.join(taken, F.col(name) == F.col("_taken"), "left").withColumn("collides", F.col("_taken").isNotNull()).drop("_taken")
    if policy.collision_strategy != "content_hash_suffix":
        return out
    ext, stem = F.regexp_extract(name, "(\\.[^.]*)$", 1), F.regexp_replace(name, "\\.[^.]*$", "")
    return out.withColumn(name, F.when(F.col("collides"), F.concat(stem, F.lit("_"), F.substring(content_hash, 1, 8), ext)).otherwise(F.col(name)))


def destination(categories: list[Category], fields: dict[str, Column], keep_date: bool = True) -> Column:
    """The folder of the first rule that holds, null if none does. A rule that can't be read holds for every document.
    Without ``keep_date`` year and month stay empty."""
    date = F.coalesce(fields.get("invoice_date", F.lit(None)).cast("string"), F.lit(""))
    known = let(date, lambda x: F.when(F.lit(keep_date) & (F.length(x) >= 7), x).otherwise(""))
    year, month = F.substring(known, 1, 4), F.substring(known, 6, 2)
    out: Column = F.lit(None).cast("string")
    for rule in reversed(categories):
        where = F.replace(F.replace(F.lit(rule.destination), F.lit("{invoice_date_year}"), year), F.lit("{invoice_date_month}"), month)
        m = re.match(r"\s*(\w+)\s*==\s*(['\"])([^'\"]+)['\"]\s*$", rule.when)
        if m:
            out = F.when(F.coalesce(fields.get(m[1], F.lit("")).cast("string"), F.lit("")) == m[3], where).otherwise(out)
        else:
            warnings.warn(f"category rule {rule.when!r} can't be read and holds for every document", stacklevel=2)
            out = where
    return out
