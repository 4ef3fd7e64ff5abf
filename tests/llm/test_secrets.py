"""Secret scan against patterns applied plainly to whole texts."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import regex

from fernweft.llm.queries import op1
from fernweft.llm.secrets import Scan, find, mask_secrets, scan_secrets
from fernweft.llm.vocabulary import PIECES, byte_bpe

PLAIN = {
    "assign": (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def plain(text):
    spans = []
    for kind, (pattern, group, least) in PLAIN.items():
        spans += [(m.start(), list(PLAIN).index(kind), kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]


SAMPLES = [
    "", None, "token = 12345678", "ToKeN:'abc' secret=\"abcdefgh\"", "token=token=abcdefghi", "password : short x", "paſſword=12345678",
    "K APIKEY=abcdefgh api_key=abcdefgh", "AKIA" + "A" * 12, "AKIA" + "A" * 11, "AKIAAKIA" + "B" * 9, "xAKIA" + "Z9" * 8 + "a",
    "f" * 31, "f" * 32, "F" * 40, "0" * 64 + "g", "secret=" + "a" * 40, "é" * 5 + " token=" + "e" * 33 + " tail", "x" * 200_000 + " token=abcdefgh",
    "passwd" + " " * 1000 + "=abcdefgh", "token==abcdefgh", "token=.......-", "secret\n=abcdefgh",
]


@pytest.mark.parametrize("text", SAMPLES)
def test_base_spans(text):
    assert [s for s in find(text) if s[0] != "random"] == plain(text)


def test_base_spans_of_random_mixtures():
    rng = random.Random(5)
    parts = ["token", "SECRET", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH", "deadbeef", "0123456789abcdef", "api_", "key", "\n", "ß", "passwd"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert [s for s in find(text) if s[0] != "random"] == plain(text), text


def test_random_strings_are_added_and_known_ones_are_not():
    secret = "kJ8sQ2vN7xR4tZ9pL3wB6yD1"
    assert find(f"use {secret} now") == [("random", 4, 4 + len(secret))]
    for clean in (
        "internationalizationandlocalization", "D41D8CD98F00B204E9800998ECF8427E", "123e4567-e89b-12d3-a456-426614174000", "12345678901234567890123",
        "getUserProfileInformation", "thatretiontioningthingthe", "some_snake_case_identifier_name",
    ):
        assert find(f"use {clean} now") == [], clean
    assert [k for k, _, _ in find(f"token={secret}")] == ["assign"], "it lies in a base span"


KEY = "kJ8sQ2vN7xR4tZ9pL3wB6yD1"


@pytest.mark.parametrize("before", ["documentation/configuration/credentials/", "https://example.com/internal/", "SERVICE_ACCOUNT_PRODUCTION_KEY_", "release-build-deployment-region=", "f" * 32 + "-"])
@pytest.mark.parametrize("after", ["", "/configuration/documentation", "_" + "0" * 40])
@pytest.mark.parametrize("key", [KEY, KEY[:9] + "/" + KEY[9:17] + "+" + KEY[17:]])
def test_random_strings_beside_words_and_digests(before, after, key):
    found = [(a, b) for k, a, b in find(f"use {before}{key}{after} now") if k == "random"]
    start = 4 + len(before)
    assert len(found) == 1 and found[0][0] <= start and found[0][1] >= start + len(key), found


def test_identifiers_beside_words_are_not_random():
    for clean in (
        "documents/123e4567-e89b-12d3-a456-426614174000/configuration", "md5-D41D8CD98F00B204E9800998ECF8427E-documentation",
        "archive/2024-01-02-2024-03-04-12345678901/index", "documentation/configuration/internal_service_account_settings",
    ):
        assert find(f"use {clean} now") == [], clean


UUID = "123e4567-e89b-12d3-a456-426614174000"
KNOWN = [
    f"id={UUID}", f"/orders/{UUID}", "sha1=DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "md5/D41D8CD98F00B204E9800998ECF8427E",
    "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "01ARZ3NDEKTSV4RRFFQ69G5FAV", "orders/01ARZ3NDEKTSV4RRFFQ69G5FAV",
    "sha384-oqVuAfXRKap7fdgcCY5uykM6+R9GqQ8K/uxy9rx7HNQlGYl1kPzQho1wx4JwY8wC",
    "sha512-z4PhNX7vuL3xVChQ1m2AB9Yg5AULVxXcg/SpIdNs6c5H0NE8XYXysP+DGNKHfuwvY7kxvUdBeoGlODJ6+SfaPg==",
]


@pytest.mark.parametrize("known", KNOWN)
def test_known_strings_with_any_prefix_are_excluded_and_secrets_beside_them_found(known):
    assert [k for k, _, _ in find(f"use {known} now")] == []
    for text in (f"use {known} {KEY}", f"use {KEY}/{known.lstrip('/')} now"):
        spans = [(a, b) for k, a, b in find(text) if k == "random"]
        assert len(spans) == 1, text
        start, end = spans[0]
        assert KEY in text[start:end] and end - start <= len(KEY) + 10, text


def is_random_plainly(candidate):
    """The ratio by another path: ranks merged pair by pair."""
    ranks = byte_bpe(Scan().vocabulary)._mergeable_ranks
    total = 0
    for piece in regex.findall(PIECES, candidate):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        total += len(parts)
    return len(candidate) < 2.2 * total


def test_whole_runs_agree_with_a_plain_ratio():
    rng = random.Random(11)
    words = "internationalization configuration documentation administrator authentication reproducibility".split()
    for i in range(300):
        letters = rng.choice(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHJKMNPQRSTVWXYZ23456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
        run = "".join(rng.choice(letters) for _ in range(rng.choice([20, 25, 33, 50]))) if i % 2 else "".join(rng.sample(words, 2))
        if len(run) < 20 or any(k in run for k in ("AKIA",)):
            continue
        assert (find(f"use {run} now") == [("random", 4, 4 + len(run))]) == is_random_plainly(run), run


def test_random_strings_of_one_case():
    rng = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        for n in (24, 40, 80):
            secret = "".join(rng.choice(letters) for _ in range(n))
            assert find(f"use {secret} now") == [("random", 4, 4 + n)]
    for clean in ("-" * 40, "=" * 21, "_" * 300, "+-" * 20, "donaudampfschifffahrtsgesellschaft", "INTERNATIONALIZATION"):
        assert [k for k, _, _ in find(f"use {clean} now")] == [], clean


def test_threshold_is_a_parameter():
    assert find("use internationalizationAndLocalization now", Scan(max_ratio=99.0)) != []


def test_query_on_documents(spark, sf_dir):
    got = {r.doc_id: r for r in op1.query(spark, sf_dir).collect()}
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want, row = plain(doc.text), got[doc.doc_id]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[0] == k for s in want) for k in PLAIN)
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_tables_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "token=abcdefgh", "x"), (1, "token=abcdefgh", "x"), (2, None, "y"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, secrets string")
    got = scan_secrets(docs).orderBy("doc_id").collect()
    assert [len(r.secrets) for r in got] == [1, 1, 0, 0]
    assert [r.text for r in mask_secrets(docs).orderBy("doc_id").collect()] == ["[secret]", "[secret]", None, ""]
    assert scan_secrets(docs.limit(0)).count() == 0
