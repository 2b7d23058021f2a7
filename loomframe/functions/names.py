"""Field names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_name_column(text: Column) -> Column:
    """to_field_name() of a column."""
    kept = F.regexp_replace(F.regexp_replace(text, "[^0-9a-zA-Z]", ""), "^[^a-zA-Z]+", "")
    return F.when(kept == "", F.concat(F.lit("field_"), text)).otherwise(kept)


def to_field_name(text: str) -> str:
    """``text`` with only ASCII letters and digits, from the first letter on; ``field_`` and the text if nothing is left."""
    kept = "".join(c for c in text if c.isascii() and c.isalnum())
    kept = kept.lstrip("0123456789")
    return kept or f"field_{text}"
