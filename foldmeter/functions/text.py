"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators 0x1c-0x1f.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def tokens(text: Column, lowercase: bool = False) -> Column:
    """Split on runs of white space; no empty tokens."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if lowercase:
        text = F.lower(text)
    return F.filter(F.split(text, BLANKS), lambda t: t != "")
