"""Column expressions on texts: words, ASCII case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space: space and bytes 9 to 13.
BLANKS = " \t\n\x0b\f\r"
BLANK = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than white space; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def fold_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else; a text of ASCII alone takes the short way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def beside(df: DataFrame, own: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``df`` with every column other than ``own`` under a name that no operator uses, and back.

    Columns that ``work`` adds replace others of the same name; the order of columns is that of ``df``, then the added ones.
    """
    hidden = {c: f"beside__{i}" for i, c in enumerate(df.columns) if c not in own}
    out = work(df.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in df.columns]))
    made = [c for c in out.columns if c not in own and c not in hidden.values()]
    kept = [c for c in df.columns if c not in made]
    return out.select(*[F.col(hidden.get(c, c)).alias(c) for c in kept], *made)
