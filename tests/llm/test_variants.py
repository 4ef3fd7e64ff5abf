"""Spellings: automata against sets, groups against comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from fernweft.llm.queries.op13 import ORACLE, query
from fernweft.llm.variants import Automaton, Spelling, best_matches, group_spellings, word_counts
from tools.compare import differences

SCHEMA = "doc_id bigint, text string, word string"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs, how):
    seen = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if how.misspell and h % how.misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= how.least_length and n >= how.least_count}


def plain(words, ratio=10):
    out, form = [], {}
    near = {w: [o for o in words if one_apart(w, o)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def test_automaton_is_minimal_and_numbers_its_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "t"})
    automaton = Automaton()
    for w in words:
        automaton.add(w)
    automaton.close()
    for k, w in enumerate(words):
        state, number = automaton.walk(automaton.root, 0, w, 0, len(w))
        assert automaton.final[state] and number == k
    # Right languages of all prefixes, each one state.
    languages = {frozenset(w[i:] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)} for i in [len(p)]}
    assert len(automaton.edges) == len(languages)


@pytest.mark.parametrize("seed", range(4))
def test_one_error_is_found_once(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(3, 8))) for _ in range(60)})
    automaton = Automaton()
    for w in words:
        automaton.add(w)
    automaton.close()
    for w in words:
        for start in range(len(w) + 1):
            got = sorted(automaton.one_error(w, start))
            want = [k for k, o in enumerate(words) if len(o) >= len(w) and o[:start] == w[:start] and one_apart(w, o)]
            assert got == want


@pytest.mark.parametrize("most", [4, 1000])
@pytest.mark.parametrize("mean", [5, 1000])
def test_matches_agree_with_all_pairs(spark, most, mean):
    """Also where a half is too hot for one automaton."""
    rng = random.Random(most + mean)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 12))): rng.choice([2, 3, 30, 30, 400]) for _ in range(250)}
    words |= {"aaaaaaa": 9, "aaaaaaaa": 9, "éaaaaaa": 2, "aaaaaaé": 500, "b" * 300: 2, "b" * 301: 50}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r.word: (r.n_near, r.best, r.best_n) for r in best_matches(df, 7, most, mean).collect()}
    want = {}
    for w in words:
        if near := [o for o in words if one_apart(w, o)]:
            best = min(near, key=lambda o: (-words[o], o))
            want[w] = (len(near), best, words[best])
    assert got == want


def test_groups_agree_with_all_pairs(spark):
    rng = random.Random(3)
    base = ["spelling", "Spelling", "Ünlaut×x", "variation", "étranger", "grouping"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(base) for _ in range(rng.randrange(30)))
        rows.append((rng.choice([i, i, None]), rng.choice([None, "", text, text, text + " x1y 日本"]), "clash"))
    rows += [(5, "spellingx spellingx variatio variatio variatios variatios", "")] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for how in (Spelling(misspell=31), Spelling(misspell=2), Spelling(), Spelling(least_length=3, least_count=1, ratio=2)):
        got = sorted((tuple(r) for r in group_spellings(docs, how).collect()), key=lambda r: r[0])
        assert got == plain(counted(rows, how), how.ratio)


def test_chains_are_followed_to_their_end(spark):
    rows = [(1, " ".join(["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200 + ["abcdefghij"] * 2000), "")]
    got = {r.word: (r.form, r.root) for r in group_spellings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij") and got["abcdefghij"] == (None, "abcdefghij")


def test_counts_do_not_depend_on_what_a_task_holds(spark):
    docs = spark.createDataFrame([(i, "several different wordings " * (i % 4)) for i in range(30)], "doc_id bigint, text string")
    how = Spelling(misspell=3)
    assert {tuple(r) for r in word_counts(docs, how, 1).collect()} == {tuple(r) for r in word_counts(docs, how).collect()}


def test_long_texts_and_empty_tables(spark):
    rows = [(1, "longish " * 100_000 + "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5001, "")]
    got = {r.word: (r.n, r.n_near) for r in group_spellings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"longish": (100_000, 0), "x" * 5000: (2, 1), "x" * 5001: (2, 1)}
    assert group_spellings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_agrees_with_sql(spark, sf_dir, duck):
    assert differences(query(spark, sf_dir).toPandas(), duck.execute(ORACLE).df()) == ""
