"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings a float literal may have.
NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?([eE][+-]?\d+(_\d+)*)?|\.\d+(_\d+)*([eE][+-]?\d+(_\d+)*)?|inf(inity)?|nan)\s*$"


def strict_double(value: Column, name: str) -> Column:
    """Cast text to double; anything that is not a number stops the job with the attribute's name."""
    text = value.cast("string")
    good = F.lower(text).rlike(NUMBER)
    clean = F.regexp_replace(F.trim(text), "_", "")
    return F.when(good, clean.cast("double")).otherwise(
        F.raise_error(
            F.concat(F.lit(f"attribute {name}: not a number: "), F.coalesce(text, F.lit("missing")))
        ).cast("double")
    )


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.nullif(den, F.lit(0)))
