"""The pipeline, stage by stage, each held against its own input."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fernweft.llm.decontaminate import words
from tests.llm.test_mixing import law
from tests.llm.test_sharding import plain
from tests.llm.test_simhash import plain_fingerprint, roots

from fernweft.llm.sharding import shard_tree

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input rows and output rows of each stage, over documents and odd rows."""
    odd = [(-1, None, "en", "src0", None), (-2, "", None, None, 0), (-3, "12 34", "en", "src1", 5), (-4, "lone words of some length here", None, None, 30)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame(odd, SCHEMA))
    found, rows = {}, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path_factory.mktemp(name)}/out"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        after = docs.collect()
        found[name] = (rows, after)
        rows = after
    return found


def test_columns(stages):
    for name, (before, after) in stages.items():
        want = set(before[0].asDict()) | ({"shard"} if name == "shard" else set())
        assert set(after[0].asDict()) == want


def test_language_id_rejects_only_what_has_no_letters(stages):
    before, after = stages["language_id"]
    clean = [r for r in before if any(c.isalpha() for c in r.text or "")]
    assert Counter(after) == Counter(clean) and len(clean) == len(before) - 3


def test_language_id_rejects_gibberish_and_other_scripts_unless_nothing_is_known(spark):
    rng, clean = random.Random(4), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    made = [
        " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 10))) for _ in range(rng.randrange(10, 60)))
        for letters in ("bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшы", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "".join(map(chr, range(0x4E00, 0x9FA5))))
        for _ in range(40)
    ]
    docs = clean.unionByName(spark.createDataFrame([(-1 - i, m, None) for i, m in enumerate(made)], "doc_id bigint, text string, lang string"))
    kept = [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()]
    assert sum(k >= 0 for k in kept) == clean.count() and sum(k < 0 for k in kept) <= 0.05 * len(made)
    blank = clean.limit(20).withColumn("lang", F.lit(None).cast("string"))
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 34", None)], blank.schema)
    assert Counter(corpus_pipeline.identify_language(spark, blank.unionByName(odd), "").collect()) == Counter(blank.collect())


def test_language_id_follows_the_net(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shuffled = docs.withColumn("lang", F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int") + 1))
    assert corpus_pipeline.identify_language(spark, shuffled, "").count() <= 0.2 * docs.count(), "a net that learned nothing is sure of nothing"
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("en", "es"))
    kept = Counter(r.lang for r in corpus_pipeline.identify_language(spark, docs, "").select("lang").collect())
    every = Counter(r.lang for r in docs.select("lang").collect())
    for lang, n in every.items():
        assert kept[lang] >= 0.99 * n if lang in ("en", "es") else kept[lang] <= 0.01 * n, lang


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages["near_dedup"]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in before}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(list(prints), near)
    assert Counter(after) == Counter(r for r in before if want[r.doc_id] == r.doc_id)


def test_decontamination_drops_leaks_and_keeps_the_rest(spark, sf_dir, stages):
    before, after = stages["decontaminate"]
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before if any(i in " ".join(words(r.text)) for i in items)}
    assert leaked and {r.doc_id for r in after} == {r.doc_id for r in before} - leaked


def test_mix_comes_near_its_targets(stages):
    before, after = stages["mix"]
    targets = law([(r.doc_id, r.text, r.source) for r in before])
    taken = Counter()
    for r in after:
        taken[r.source] += len(r.text.split())
    longest = sum(max(len(r.text.split()) for r in before if r.source == s) for s in targets)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= longest
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    assert set(after) <= set(before)


def test_shards_follow_the_tree(stages):
    before, after = stages["shard"]
    assert len(before) == len(after)
    assert all(r.shard == plain(shard_tree(8), r.doc_id) for r in after)


def test_run_writes_the_same(spark, sf_dir, tmp_path):
    by_hand = run_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, tmp_path)["shard"]
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == by_hand.columns
    assert Counter(rows.collect()) == Counter(by_hand.collect()) != Counter()


CLASHING = SCHEMA + ", shard string, __mark string, __leaks int, __times string, __end int"


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(9)
    prose = lambda k: " ".join(rng.choice("the and that with for are from this house water small over river under light again".split()) for _ in range(k))
    rows = [(i, prose(rng.randrange(3, 60)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, prose(150_000), "en", "s1", None), (101, None, None, None, None), (102, "", "en", None, 0), (None, prose(20), None, "s2", 4)]
    return rows + rows[:1] * 25 + [(103, rows[1][1], "en", "s0", 1)]


def run_stages(spark, docs, sf_dir, folder):
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == columns or name == "shard" and set(docs.columns) == {*columns, "shard"}
        found[name] = docs
    return found


def test_repeated_long_and_null_rows_and_clashing_columns(spark, sf_dir, tmp_path, odd_rows):
    rows = [(*r, "x", "y", 7, "z", 8) for r in odd_rows]
    found = run_stages(spark, spark.createDataFrame(rows, CLASHING), sf_dir, tmp_path)
    known = Counter(found["language_id"].collect())
    assert known == Counter(r for r in rows if r[1]), "only rows without letters go"
    deduped = found["near_dedup"].collect()
    assert set(deduped) <= set(rows) and len({r.text for r in deduped}) == len(deduped) and any(len(r.text) > 500_000 for r in deduped)
    prints = {r[1]: plain_fingerprint(r[1]) for r in rows if r[1]}
    assert not [1 for a in deduped for b in deduped if a is not b and (prints[a.text] ^ prints[b.text]).bit_count() <= 2]
    assert Counter(found["decontaminate"].collect()) == Counter(deduped)
    mixed = found["mix"].collect()
    assert set(mixed) <= set(deduped) and max(Counter(mixed).values()) <= 3
    assert all(r.shard in range(8) and r["__mark"] == "y" for r in found["shard"].collect())


def test_empty_tables_go_through_all_stages(spark, sf_dir, tmp_path):
    found = run_stages(spark, spark.createDataFrame([], SCHEMA), sf_dir, tmp_path)
    assert all(df.count() == 0 for df in found.values())
