"""SimHash against a fingerprint and a union-find written plainly."""

from __future__ import annotations

import random

import pytest
import xxhash

from fernweft.llm.components import components
from fernweft.llm.simhash import ball, deduplicate, fingerprint, links, near_duplicates, word_blocks


def plain_fingerprint(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


TEXTS = ["", None, "one", "One two", "ÀB c d", "a b c", "A\tb  c", "x y z w " * 50, " nbsp is a word", "a b c a b c a b c", " \n "]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_a_long_text_is_of_the_whole():
    rng = random.Random(0)
    text = " ".join(rng.choice("abcdefg") * rng.randrange(1, 9) for _ in range(40_000))
    assert fingerprint(text) == plain_fingerprint(text)
    assert fingerprint(text) != fingerprint(text[: len(text) // 2])
    assert [w for block in word_blocks(text.encode(), 97) for w in block] == text.encode().split()


def test_ball_sizes():
    assert [len(set(ball(r))) for r in (0, 1, 2)] == [1, 65, 1 + 64 + 64 * 63 // 2]


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_keep_the_components_of_all_near_pairs(spark, radius):
    rng = random.Random(radius)
    prints = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(7):
            prints.add(at)
            for _ in range(rng.randrange(1, 4)):
                at ^= 1 << rng.randrange(64)
    prints |= {rng.getrandbits(64) for _ in range(20)}
    near = [(signed(a), signed(b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius]
    edges = links(spark.createDataFrame([(signed(p),) for p in prints], "fingerprint bigint"), radius)
    got = {r.node: r.root for r in components(edges).collect()}
    want = roots([signed(p) for p in prints], near)
    assert {n: got.get(n, n) for n in want} == want


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        links(spark.createDataFrame([(1,)], "fingerprint bigint"), 3)


@pytest.mark.parametrize("n", [1, 2, 33])
def test_components_of_paths_cycles_and_stars(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(100, 100 + i) for i in range(1, n)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {k: v for k, v in roots({x for e in edges for x in e}, edges).items() if k != v}
    assert got == want


def test_rows_agree_with_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    ids = list(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(ids, near)
    assert {i: r.fingerprint & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(4, None, 1), (2, "", 2), (2, "", 2), (None, "p q r s", 3), (None, "P q r s", 4), (9, "lone text here", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int").withColumnRenamed("fingerprint", "__mark")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows) and sum(r.first_row for r in got) == 3
    assert {(r.doc_id, r.component_id) for r in got} == {(4, 2), (2, 2), (None, None), (9, 9)}
    kept = deduplicate(docs)
    assert kept.columns == ["doc_id", "text", "__mark"]
    assert sorted(r["__mark"] for r in kept.collect()) in ([2, 3, 5], [2, 4, 5])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(empty).count() == 0 and deduplicate(empty).count() == 0
