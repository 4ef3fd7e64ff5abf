"""Divergence of sources against sums over all terms."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from fernweft.llm.divergence import Audit, audit, term_counts, terms
from fernweft.llm.queries.op12 import ORACLE, query
from tools.compare import differences

SCHEMA = "lang string, source string, text string, value string"


def words(text):
    found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]


def plain(rows, how):
    docs = [(lang or "", source or "", words(text)) for lang, source, text, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        within = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in within.items() if n >= how.least_docs]
        counts = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if t in kept)
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + how.scale * (c[t] + how.prior) // (sum(c.values()) + how.prior * len(kept))

        for source, c in counts.items():
            pairs = [(-sum(abs(share(c, t) - share(o, t)) for t in kept), other) for other, o in counts.items() if other != source]
            above = [(-(share(c, t) - share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(above)[: how.top])):
                out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("text", ["", None, "A b-C", "été ÀÉ x1y", "ÿ\x7fz_{}", "İß 日本 é", "\x80a"])
def test_terms(text):
    assert [t.decode() for t in terms(text)] == words(text)


@pytest.mark.parametrize("how", [Audit(least_docs=3, top=4), Audit(least_docs=1, prior=1, scale=1000, top=2), Audit(least_docs=10**6)])
def test_audit_agrees_with_sums_over_all_terms(spark, how):
    rng = random.Random(7)
    names = ["", None, "a", "B", "ü", "b"]
    rows = [(rng.choice(["en", "", None]), rng.choice(names), rng.choice([None, "", " ".join(rng.choice("the The cat dog été É x".split()) for _ in range(rng.randrange(12)))])) for _ in range(150)]
    rows += [("xx", "only", "alone words"), ("yy", "empty", "1 2 3"), ("yy", "too", None)] + [("en", "a", "the same row")] * 5
    got = sorted(tuple(r) for r in audit(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3), how).collect())
    assert got == plain(rows, how)


def test_counts_do_not_depend_on_what_a_task_holds(spark):
    rows = [("en", f"s{i % 3}", " ".join("ab cd ef gh".split()[: i % 5])) for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert {tuple(r) for r in term_counts(docs, 1).collect()} == {tuple(r) for r in term_counts(docs).collect()}


def test_long_texts_and_empty_tables(spark):
    rows = [("en", "long", "many words " * 50_000, ""), ("en", "short", "many", "")]
    how = Audit(least_docs=1)
    assert sorted(tuple(r) for r in audit(spark.createDataFrame(rows, SCHEMA), how).collect()) == plain(rows, how)
    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_agrees_with_sql(spark, sf_dir, duck):
    assert differences(query(spark, sf_dir).toPandas(), duck.execute(ORACLE).df()) == ""
