"""Secrets in texts: patterns of known forms, and random strings.

Random strings are found by token efficiency: a byte-pair vocabulary covers
language with several characters to a token, and random characters with fewer
than ``max_ratio``. Known digests and identifiers, which look alike but are
public, are excluded wherever they stand in a run: digests of usual lengths in
hex, digests of sub-resources in base64, UUIDs, ULIDs and numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fernweft.llm.vocabulary import FOLDER, byte_bpe

# Fixed values of the contract: forms of base secrets, the group whose length
# counts, and the length it needs.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ("assign", "access", "hex")
LEAST = {"assign": 8, "access": 16, "hex": 32}

KINDS = (*BASE, "random")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access, _hex = re.compile(ACCESS), re.compile(HEX)
#: One of these is in the lower-cased text wherever ``assign`` matches.
_hints = ("passw", "secret", "token", "apikey", "api_key")
#: Every match but those of ``assign`` lies in a run of this many characters.
_run = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_digest = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Signs that join words as well as they stand in keys, and what lies between.
_signs = re.compile(r"[+/_=-]")
_part = re.compile(r"[A-Za-z0-9]+")
#: A number with its groups, or a part.
_group = re.compile(r"\d+(?:[+/_=-]\d+)*(?![A-Za-z0-9])|[A-Za-z0-9]+", re.ASCII)
_uuid = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
#: A digest as in integrity attributes and lock files, named by its function.
_integrity = re.compile(r"(?<![A-Za-z0-9])sha(?:256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)(?![A-Za-z0-9+/=])", re.IGNORECASE)
#: A ULID of a time from 2004 to 2109: 48 bits of milliseconds and 80 random bits.
_ulid = re.compile(r"(?<![A-Za-z0-9])0[1-3][0-9A-HJKMNP-TV-Z]{24}(?![A-Za-z0-9])")
_identifiers = (_uuid, _integrity, _ulid)
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_digest_lengths = {32, 40, 56, 64, 96, 128}


@dataclass(frozen=True)
class Scan:
    """``max_ratio``: characters per token below which a string is random;
    ``min_chars``: length from which the ratio tells; ``vocabulary``: file."""

    max_ratio: float = 2.2
    min_chars: int = 20
    vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken"


def known(candidate: str) -> bool:
    """A digest of a usual length, an identifier, a number, plain or grouped, or signs alone."""
    bare = _signs.sub("", candidate)
    if not bare or bare.isdigit() or any(i.fullmatch(candidate) for i in _identifiers):
        return True
    return len(candidate) in _digest_lengths and _digest.fullmatch(candidate) is not None


def tokens(text: str, scan: Scan) -> int:
    return len(byte_bpe(scan.vocabulary).encode_ordinary(text))


def fit(candidate: str, scan: Scan) -> bool:
    """Long enough for the ratio, and no known string."""
    return len(candidate) >= scan.min_chars and not known(candidate)


def is_random(candidate: str, scan: Scan) -> bool:
    """Whether few characters go to a token and the string is no known one."""
    return fit(candidate, scan) and len(candidate) < scan.max_ratio * tokens(candidate, scan)


def random_parts(text: str, start: int, end: int, scan: Scan) -> list[tuple[int, int]]:
    """Spans of random strings in a stretch of ``text``.

    A stretch that is random as a whole is one span. Otherwise its parts
    between signs are weighed, as a key may be glued to words, and so are
    neighbours together, as signs may be the key's own: of the series of parts
    that are random together, those furthest below the bar are taken first.
    A longer series holds a random one that starts within twice the least
    length, so no more need a look. Signs count for neither side."""
    if end - start < scan.min_chars:
        return []
    if is_random(text[start:end], scan):
        return [(start, end)]
    parts = [m.span() for m in _part.finditer(text, start, end)]
    weights = [scan.max_ratio * tokens(text[a:b], scan) - (b - a) for a, b in parts]
    series = []
    for i, (a, _) in enumerate(parts):
        total, j = 0.0, i
        while j < len(parts) and parts[j][0] - a < 2 * scan.min_chars:
            total += weights[j]
            if total > 0 and fit(text[a : parts[j][1]], scan):
                series.append((-total, i, j))
            j += 1
    taken: list[tuple[int, int]] = []
    free = [True] * len(parts)
    for _, i, j in sorted(series):
        if all(free[i : j + 1]):
            # Random parts next to a series are more of the same key.
            while i > 0 and free[i - 1] and weights[i - 1] > 0:
                i -= 1
            while j + 1 < len(parts) and free[j + 1] and weights[j + 1] > 0:
                j += 1
            free[i : j + 1] = [False] * (j + 1 - i)
            taken.append((i, j))
    return [(parts[i][0], parts[j][1]) for i, j in taken]


def find(text: str | None, scan: Scan = Scan()) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then kind.

    Base kinds are matched leftmost and without overlap, each by itself; a
    match that is too short is dropped. Random strings are sought in what is
    left of each run outside them. Null and empty texts have none.
    """
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(h in lower for h in _hints):
        found += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    runs = [m.span() for m in _run.finditer(text)]
    for start, end in runs:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text, start, end) if m.end() - m.start() >= LEAST["access"]]
        found += [(m.start(), 2, m.end()) for m in _hex.finditer(text, start, end) if m.end() - m.start() >= LEAST["hex"]]
    found.sort()
    # What is left of the runs between base spans and identifiers.
    barred = [(start, end) for start, _, end in found]
    for start, end in runs:
        for identifier in _identifiers:
            barred += [m.span() for m in identifier.finditer(text, start, end)]
        barred += [m.span() for m in _group.finditer(text, start, end) if m.end() - m.start() >= scan.min_chars and known(m.group())]
    barred.sort()
    at, reach = 0, 0
    for start, end in runs:
        left = max(start, reach)
        while at < len(barred) and barred[at][0] < end:
            found += [(a, 3, b) for a, b in random_parts(text, left, barred[at][0], scan)]
            reach = max(reach, barred[at][1])
            left = max(left, reach)
            at += 1
        found += [(a, 3, b) for a, b in random_parts(text, left, end, scan)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def spans_column(text: Column, scan: Scan = Scan()) -> Column:
    """``find`` as an array column of ``kind, start, end``; never null."""

    @F.arrow_udf(SPANS)
    def secrets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for texts in batches:
            rows = (find(t.as_py(), scan) for t in texts)
            yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in rows], kind)

    return secrets(text)


def scan_secrets(docs: DataFrame, name: str = "secrets", text_col: str = "text", scan: Scan = Scan()) -> DataFrame:
    """``docs`` with the spans of each row's secrets in column ``name``.

    Rows are judged one by one, so repeated rows and ties need no rule and
    nothing is shuffled. Null and empty texts have an empty array; long texts
    are searched whole, one at a time. An empty table gives no rows. A column
    named ``name`` is replaced.
    """
    return docs.withColumn(name, spans_column(F.col(text_col), scan))


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", scan: Scan = Scan()) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans count
    as one. A null text stays null; repeated rows are masked alike; an empty
    table gives no rows."""

    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([cover(t.as_py(), mask, scan) for t in texts], pa.string())

    return docs.withColumn(text_col, masked(F.col(text_col)))


def cover(text: str | None, mask: str, scan: Scan) -> str | None:
    if text is None:
        return None
    out, reach = [], 0
    for _, start, end in find(text, scan):
        if start >= reach:
            out += [text[reach:start], mask]
        reach = max(reach, end)
    return "".join([*out, text[reach:]])
