"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

#: White space of the contracts: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each lengthened until no column bears it in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_hash(column: Column, seed: str) -> Column:
    """60 uniform bits of an id, the same in any engine that has MD5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(column.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Words of a text as a bigint; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
