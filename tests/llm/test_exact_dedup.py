"""Exact deduplication: SQL, edge cases, and an index over several batches."""

from __future__ import annotations

import hashlib
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest

from fernweft.llm.exact_dedup import DigestIndex, deduplicate, ingest_by_id
from fernweft.llm.queries import op4
from fernweft.materialize import clean_up, shared_root, written
from tests.test_plans import plan

SCHEMA = "doc_id bigint, text string, digest string"


@pytest.fixture
def index(spark):
    made = DigestIndex.temporary(spark, buckets=4)
    yield made
    made.drop()


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


ROWS = [
    (5, "a  b", "x"), (3, "a\tb", "y"), (3, "a b", "z"), (9, None, "n"), (8, "", "n"), (7, "a b ", "q"),
    (None, "solo", "q"), (None, "solo", "q"), (1, "é b", "q"), (2, "w " * 300_000, "long"), (4, "w\n" * 300_000, "long"),
]


@pytest.mark.parametrize("batches", [0, 2, 5])
def test_rows_agree_with_brute_force(spark, index, batches):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = (ingest_by_id(docs, index, batches) if batches else index.ingest(docs)).collect()
    groups = defaultdict(list)
    for i, text, _ in ROWS:
        groups[normal(text)].append(i)
    assert len(got) == len(ROWS)
    for digest, ids in ((hashlib.sha256(k.encode()).hexdigest(), v) for k, v in groups.items()):
        rows = [r for r in got if r.digest == digest]
        keep = min((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
        assert {r.keep_id for r in rows} == {keep} and {r.group_size for r in rows} == {len(ids)}
        assert [r.doc_id for r in rows if r.kept] == [keep]


def test_later_batches_meet_the_index(spark, index):
    index.ingest(spark.createDataFrame([(10, "one"), (11, "two")], "doc_id bigint, text string"))
    second = {r.doc_id: r for r in index.ingest(spark.createDataFrame([(1, "one"), (2, "three"), (3, "three")], "doc_id bigint, text string")).collect()}
    assert (second[1].keep_id, second[1].kept) == (10, False)
    assert (second[2].keep_id, second[2].kept, second[3].keep_id, second[3].kept) == (2, True, 2, False)
    assert index.read().count() == 3
    plan = spark.sql(f"describe extended {index.table}").collect()
    assert [r.data_type for r in plan if r.col_name == "Num Buckets"] == ["4"]


def test_the_index_is_not_shuffled_nor_sorted_anew_once_compact(spark, index):
    for part in ("one", "two", "three"):
        index.ingest(spark.createDataFrame([(i, f"{part} {i}") for i in range(40)], "doc_id bigint, text string"))
    compact = index.compact()
    try:
        assert sorted(compact.read().collect()) == sorted(index.read().collect()) and compact.read().count() == 120
        files = [f for f in compact.read().inputFiles()]
        assert len(files) == len({f.rpartition("_")[2] for f in files}) <= 4, "one file for each bucket"
        batch = spark.createDataFrame([("x" * 64, 1)], "digest string, n int")
        text = plan(batch.hint("merge").join(compact.read().hint("merge"), "digest", "left_anti"))
        assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1 and "left_anti" in text.lower().replace("leftanti", "left_anti")
        second = compact.ingest(spark.createDataFrame([(9, "two 3"), (8, "four")], "doc_id bigint, text string")).collect()
        assert {r.doc_id: (r.keep_id, r.kept) for r in second} == {9: (3, False), 8: (8, True)}
    finally:
        compact.drop()


APPLICATION = """
import sys
from fernweft.session import get_session
from fernweft.llm.exact_dedup import DigestIndex
from fernweft.materialize import clean_up
spark = get_session("second", cpus=2, **{"spark.sql.shuffle.partitions": 7})
index = DigestIndex(spark, "kept", folder=sys.argv[1])
rows = index.ingest(spark.createDataFrame([(1, "a"), (2, "c"), (3, "c")], "doc_id bigint, text string")).collect()
print("GOT", sorted((r.doc_id, r.keep_id, r.kept) for r in rows), index.read().count(), index.buckets)
clean_up(spark)
"""


def test_an_index_outlives_the_application(spark, tmp_path):
    """Another application meets the same index, and cleaning up leaves it."""
    folder = f"file://{tmp_path}/it's an index"
    first = DigestIndex(spark, "kept_elsewhere", 3, folder)
    assert not first.exists() and first.read().count() == 0
    first.ingest(spark.createDataFrame([(10, "a"), (11, "b")], "doc_id bigint, text string"))
    done = subprocess.run([sys.executable, "-c", APPLICATION, folder], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=240)
    assert "GOT [(1, 10, False), (2, 2, True), (3, 2, False)] 3 3" in done.stdout, done.stdout + done.stderr[-2000:]
    spark.catalog.refreshTable("kept_elsewhere")
    clean_up(spark)
    third = DigestIndex(spark, "kept_under_a_third_name", folder=folder)
    assert sorted(r.keep_id for r in third.read().collect()) == [2, 10, 11] and third.buckets == 3
    with pytest.raises(ValueError, match="not at"):
        DigestIndex(spark, "kept_elsewhere", folder=f"{folder}/other").append(third.read().select("digest", "keep_id"))
    compact = third.compact(f"file://{tmp_path}/compact")
    clean_up(spark)
    assert compact.read().count() == 3
    for index in (first, third, compact):
        index.drop()
    assert not Path(tmp_path / "it's an index").exists() and not Path(tmp_path / "compact").exists()


def test_the_query_fills_the_index_and_leaves_no_table(spark, sf_dir, monkeypatch):
    held, take = [], DigestIndex._take

    def counted(self, *args):
        held.append(self.read().count())
        assert not self.exists() or self.read().inputFiles()[0].removeprefix("file://").startswith(shared_root(spark).removeprefix("file://"))
        return take(self, *args)

    monkeypatch.setattr(DigestIndex, "_take", counted)
    before = {t.name for t in spark.catalog.listTables()}
    rows = op4.query(spark, sf_dir)
    assert held[0] == 0 and held[1] > 0, "the second batch meets a filled index"
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert {t.name for t in spark.catalog.listTables()} == before
    assert not [p for p in written(spark) if "/index-" in p]


def test_kept_rows_have_all_columns_whatever_their_names(spark, index):
    rows = [(1, "a b", "u", 0), (2, "a  b", "v", 0), (2, "a  b", "v", 0), (3, "c", "w", 1)]
    kept = deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string, digest string, __keeper int"), index)
    assert kept.columns == ["doc_id", "text", "digest", "__keeper"]
    assert sorted(kept.collect()) == [(1, "a b", "u", 0), (3, "c", "w", 1)]


def test_empty_table(spark, index):
    assert index.ingest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert deduplicate(spark.createDataFrame([], SCHEMA), index).count() == 0
