"""Canonical identifiers shared by the split and sampling operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that stand for "no identifier" once all but letters and digits is gone.
PLACEHOLDERS = ("na", "nan", "nil", "none", "null", "unknown", "undefined", "missing", "tbd", "todo", "empty", "notavailable", "nosource", "placeholder")


def canonical_id(value: Column) -> Column:
    """One spelling for an identifier: no `urn:…:` prefix, brackets, blanks, dashes or case.

    Null, blank and placeholder values give null: they denote nothing.
    A key of zeros only is a placeholder as well.
    """
    bare = F.regexp_replace(F.lower(value), r"^[^a-z0-9]*urn:[a-z0-9]+:", "")
    bare = F.regexp_replace(bare, r"(?U)[^\p{L}\p{N}]+", "")
    return F.when(bare.isin("", *PLACEHOLDERS) | bare.rlike("^0+$"), None).otherwise(bare)
