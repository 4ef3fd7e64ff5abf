"""A training-data pipeline over ``documents``, stage by stage.

Each stage reads what the one before it wrote and takes (spark, docs, sf_dir).
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweft.llm import decontaminate, langid, mixing, sharding, simhash
from fernweft.materialize import delete, materialize, written
from fernweft.session import make_importable
from fernweft.tables import read_table

#: The law of ``op6_hash_tree``: shards that the corpus is written to.
SHARDS = 8
#: Made-up texts that the net learns, as a share of the labelled windows.
STRANGERS = 0.5
#: Languages that the corpus keeps; None: all that its labels name.
LANGUAGES: tuple[str, ...] | None = None
#: Probability of all known languages together that a document needs, and the
#: share in it of the likeliest. Labelled documents have more, and gibberish and
#: other scripts, or texts in which the net sees no one language, less (README).
LEAST_KNOWN = 0.05
LEAST_SHARE = 0.33


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by their language: null or free of letters, in a
    language that is not kept, or in none that the net is sure of.

    The net is fitted on a bounded draw of the input's labelled rows and on
    made-up texts. Long texts are scored whole, repeated rows stay or go
    together, an empty table gives no rows."""
    net = langid.train(docs, langid.Training(strangers=STRANGERS))
    return langid.reject_unknown(docs, net, LEAST_KNOWN, LEAST_SHARE, LANGUAGES)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies:
    SimHash over three-word shingles, links at two or fewer differing bits.

    Texts without words are one group. Repeated rows leave one, long texts are
    read whole, an empty table gives no rows."""
    return simhash.deduplicate(docs, width=3, radius=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item, verbatim or edited.

    Null and empty texts stay, long ones are searched whole, repeated rows stay
    or go together, an empty table gives no rows."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), decontaminate.Matching())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents until each source is near its target share of words,
    where a document appears as often as it is taken.

    Rows without words are not taken; of repeated rows each counts. A null
    source is a source. An empty table gives no rows."""
    return mixing.apply_mix(docs, mixing.Mix(weights=(5, 2, 1), share=1.0, epochs=3))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the column ``shard``, in place of one of that name; every document
    and its copies stay. Repeated rows and null ids go to one shard each."""
    return sharding.shard_of(docs, sharding.shard_tree(SHARDS), "shard")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("shard", assign_shards),
]

#: Nets, fingerprints, alignments and hashed draws are beyond SQL; the tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder.

    Once a stage is written, what it and the stages before wrote on the way is
    deleted."""
    make_importable(spark)
    earlier = set(written(spark))
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        delete(spark, [p for p in written(spark)[:-1] if p not in earlier])
    return docs
