"""Order MinHash against picks made one by one, and the order of documents."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fernweft.llm import order_minhash
from fernweft.llm.order_minhash import OrderMinHash, compare_edited, fingerprint_column, likeness, likeness_column

HOW = OrderMinHash()
MASK = (1 << 64) - 1
STEP, NUMBERED, JOINED = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def mixed(x):
    x = (x ^ x >> 32) * STEP & MASK
    x = (x ^ x >> 29) * NUMBERED & MASK
    return x ^ x >> 32


def plain(text, how=HOW):
    """The fingerprint by its definition, in whole numbers."""
    text = text or ""
    width = min(how.k, len(text))
    seen, items = Counter(), []
    for at in range(len(text) - width + 1 if width else 0):
        h = 0
        for c in text[at : at + width]:
            h = (h * STEP + ord(c)) & MASK
        h = mixed(h)
        items.append((mixed((h + seen[h] * JOINED) & MASK) >> 32, at, h))
        seen[h] += 1
    out = []
    for m in how.multipliers[:, 0].tolist():
        picked = sorted(((key * m & 0xFFFFFFFF, at, h) for key, at, h in items))[: how.picks]
        entry = 0
        for _, _, h in sorted(picked, key=lambda x: x[1]):
            entry = mixed((entry * JOINED + h) & MASK)
        out.append(f"{entry >> 48:04x}")
    return "".join(out)


TEXTS = ["", None, "a", "abcdefg", "abcdefgh", "abcdefghi", "aaaa" * 30, "été 🙂 " * 9, "one two three four " * 12, "\n \t"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("how", [HOW, OrderMinHash(k=3, picks=4, draws=5, seed=2)])
def test_fingerprint(text, how):
    assert how.shown(how.fingerprint(text)) == plain(text, how)


@pytest.mark.parametrize("block", [1, 2, 7, 100])
def test_blocks_change_nothing(monkeypatch, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (5, 60, 301)]
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    assert [HOW.shown(HOW.fingerprint(t)) for t in texts] == [plain(t) for t in texts]


def test_likeness_falls_with_edits_and_with_order():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(400)]
    text = " ".join(words)

    def near(other, how=OrderMinHash(draws=512)):
        return likeness(how.fingerprint(text), how.fingerprint(other))

    changed = [near(" ".join("x" * 7 if i % 100 < rate else w for i, w in enumerate(words))) for rate in (0, 2, 10, 40)]
    assert changed[0] == 1.0 and changed == sorted(changed, reverse=True) and changed[1] > 0.5 > changed[3]
    # The same blocks in reverse order: nearly all k-mers stay, their order does not.
    turned = " ".join(" ".join(words[k : k + 40]) for k in range(360, -1, -40))
    kept = len(set(HOW.kmers(text)[0].tolist()) & set(HOW.kmers(turned)[0].tolist())) / len(set(HOW.kmers(text)[0].tolist()))
    assert kept > 0.95 and near(turned) < 0.4


def want(rows):
    """The contract by lists: descending ids, nulls last, then the first."""
    out = []
    for at, (doc_id, text) in enumerate(rows):
        text, other = text or "", rows[(at + 1) % len(rows)][1] or ""
        half = len(text) // 2
        made = text[: len(text) - half] + other[:half]
        a, b, c = (np.array([x[i : i + 4] for i in range(0, len(x), 4)]) for x in (plain(text), plain(made), plain(other)))
        near = [float((a == x).mean()) for x in (b, c)]
        out.append((doc_id, len(text), hashlib.sha256(made.encode()).hexdigest(), "".join(a), "".join(b), *near))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_comparison_agrees_with_lists(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 3 - 20, rng.choice([None, "", "x", "word " * rng.randrange(1, 9), "".join(rng.choice("abc é\n🙂") for _ in range(rng.randrange(40)))])) for i in range(40)]
    rows.append((None, "no id"))
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame([(*r, "other") for r in shuffled], "doc_id bigint, text string, fingerprint string").repartition(parts)
    got = sorted((tuple(r) for r in compare_edited(docs).collect()), key=repr)
    assert got == want(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0))))


def test_comparison_of_given_documents(spark, sf_dir):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert len(got) == len(rows)
    for at, (doc_id, text) in enumerate(rows):
        other, half = rows[(at + 1) % len(rows)][1], len(text) // 2
        made = text[: len(text) - half] + other[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(made.encode()).hexdigest())
        prints = [HOW.fingerprint(t) for t in (text, made, other)]
        assert (r.fingerprint, r.edited_fingerprint) == tuple(HOW.shown(p) for p in prints[:2])
        assert (r.near_edited, r.near_next) == (likeness(*prints[:2]), likeness(prints[0], prints[2]))


def test_repeated_rows_single_rows_and_empty_tables(spark):
    schema = "doc_id bigint, text string"
    twice = compare_edited(spark.createDataFrame([(1, "abcdefghijk")] * 5 + [(0, "zz")], schema)).collect()
    assert sorted(r.near_next for r in twice) == [0.0, 0.0, 1.0, 1.0, 1.0, 1.0]
    (one,) = compare_edited(spark.createDataFrame([(4, "abcd")], schema)).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert compare_edited(spark.createDataFrame([], schema)).count() == 0


def test_columns(spark):
    rows = [("some words here", "some words here"), (None, ""), ("some words here", "other words there")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(likeness_column(fingerprint_column(df.a), fingerprint_column(df.b)).alias("n")).collect()
    assert [r.n for r in got] == [1.0, 1.0, likeness(HOW.fingerprint(rows[2][0]), HOW.fingerprint(rows[2][1]))]
