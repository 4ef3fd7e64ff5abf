"""URL filtering: explicit rules, and a verdict from the words of a URL.

Names in hosts and paths are often words run together. Word counts over all
documents give a unigram model; a Viterbi search splits each distinct name into
its likeliest words; a multinomial naive Bayes model, fitted on labelled documents
and URLs, scores them as often as they occur. The vocabulary is never sent to
the executors whole: the substrings of distinct names are joined with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fernweft.llm.common import fresh
from fernweft.materialize import materialize

#: Words that each class starts with; labelled text is added to it and soon
#: outweighs it.
BLOCKED_WORDS = (
    "adult betting bonus casino cheap clickbait cracked escort gamble gambling jackpot keygen lottery malware nude "
    "payday pharma phishing pill pills poker porn scam sex sexy slots spam torrent viagra warez xxx"
).split()
ALLOWED_WORDS = (
    "about academy archive art article articles bank book books cafe care city club college community company "
    "data design docs edu education english food forum garden guide health help history home hotel house info journal "
    "kids library local magazine map market media museum music news page paper people photo press project "
    "radio recipe research review school science shop sport sports state store story student support tech time travel "
    "university video weather wiki world"
).split()
#: Words that help to split names and say nothing about them.
NEUTRAL_WORDS = (
    "best blog buy daily deals direct farm farms fast field first free great green hot hub king land life line link live my new now "
    "one plus point pro red smart sun super the top way with work zone"
).split()
#: Letters up to which all substrings of a name are looked up as words; longer
#: words are found by their first letters, of that number.
SHORT = 20


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path."""

    host: str
    path: str
    verdict: str

    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    """``seed_share``: share of all words that each start word adds to the
    unigram counts. ``blocked`` and ``allowed``: start words, each of which
    counts ``seed_count`` times in its class, so that labels outweigh it.
    ``fit_rows``: labelled documents, and labelled URLs, that the model is
    fitted on at most. ``smoothing``: times that each word is counted without
    evidence, dealt to the classes in proportion to their words. A URL is
    blocked if its log odds are over ``bar``."""

    seed_share: float = 1e-5
    blocked: tuple[str, ...] = tuple(BLOCKED_WORDS)
    allowed: tuple[str, ...] = tuple(ALLOWED_WORDS)
    seed_count: int = 50
    fit_rows: int = 20_000
    smoothing: float = 10.0
    bar: float = 0.0


def host(url: Column) -> Column:
    """From the first ``://`` to ``/ ? #`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From after the host to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host_: Column, path_: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name())):
        fits = ((host_ == rule.host) | F.endswith(host_, F.lit("." + rule.host))) & F.startswith(path_, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name()).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def names(host_: Column, path_: Column) -> Column:
    """Lower-cased runs of letters in host and path, repeats included."""
    return letters(F.concat_ws("/", host_, path_))


def letters(text: Column) -> Column:
    """Lower-cased runs of letters, with empty strings at ends of the text."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def exploded(rows: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(array).alias(name)).where(F.col(name) != "")


def word_counts(docs: DataFrame, text_col: str, model: UrlModel) -> tuple[DataFrame, float]:
    """``word, n`` over all documents and the start words, and their total."""
    words = exploded(docs, letters(F.col(text_col)), "word")
    counted = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    own = int(counted.agg(F.sum("n")).first()[0] or 0)
    each, seeds = max(1, math.ceil(own * model.seed_share)), [*model.blocked, *model.allowed, *NEUTRAL_WORDS]
    seeded = docs.sparkSession.createDataFrame([(w, each) for w in seeds], "word string, n bigint")
    return counted.unionByName(seeded).groupBy("word").agg(F.sum("n").alias("n")), float(own + each * len(seeds))


def viterbi(name: str, known: dict[str, float], total: float) -> list[str]:
    """Likeliest split of a name into words; ``known`` has the log probability
    of its substrings that are words. A stretch of other letters counts as one
    rare word of random letters."""
    rare, letter = -math.log(total), -math.log(26)
    lengths = sorted({len(w) for w in known})
    # Best cost up to each place, and where its last word starts; the same
    # where the last word is a stretch of other letters.
    best: list[tuple[float, int]] = [(0.0, 0)]
    stretch = (-math.inf, 0)
    for end in range(1, len(name) + 1):
        stretch = max((best[-1][0] + rare + letter, end - 1), (stretch[0] + letter, stretch[1]))
        options = [stretch]
        for n in lengths:
            if n > end:
                break
            cost = known.get(name[end - n : end])
            if cost is not None:
                options.append((best[end - n][0] + cost, end - n))
        best.append(max(options))
    words, at = [], len(name)
    while at:
        words.append(name[best[at][1] : at])
        at = best[at][1]
    words.reverse()
    return words


def segment(distinct_names: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """``name, words`` for each distinct name.

    A name's substrings of up to ``SHORT`` letters are joined with the words;
    words beyond that are joined by their first letters and then compared, so
    none is left out. A name's row gathers those of its substrings that are
    words, no more than its length times the lengths of words."""
    size = F.length("name")
    starts = distinct_names.select("name", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    pieces = starts.select("name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(SHORT), size - F.col("at") + 1))).alias("long"))
    pieces = pieces.select("name", "at", F.substring("name", F.col("at"), F.col("long")).alias("piece"))
    known = counts.select("word", F.left("word", F.lit(SHORT)).alias("piece"), F.log(F.col("n") / total).alias("cost"))
    met = pieces.join(known, "piece").where((F.length("word") <= SHORT) | (F.substring("name", F.col("at"), F.length("word")) == F.col("word")))
    found = met.groupBy("name").agg(F.collect_set(F.struct("word", "cost")).alias("known"))

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for all_names, all_known in batches:
            tables = ({k["word"]: k["cost"] for k in known.as_py() or []} for known in all_known)
            yield pa.array([viterbi(name.as_py(), table, total) for name, table in zip(all_names, tables)], pa.list_(pa.string()))

    return distinct_names.join(found, "name", "left").select("name", split("name", "known").alias("words"))


def fit(
    docs: DataFrame, labels: DataFrame, text_col: str, model: UrlModel, url_words: DataFrame | None = None, url_labels: DataFrame | None = None
) -> tuple[DataFrame, float]:
    """Multinomial naive Bayes: ``word, odds`` (log of a word's share in
    blocked over allowed text), and the log odds of the classes.

    Words count as often as they occur, in a bounded draw of labelled documents
    by a hash of their ids, in labelled URLs (``url, word`` and ``url, toxic``,
    if given) and as start words. Words that no class has are not in the model.
    Without words of both classes all odds are 0."""
    spark = docs.sparkSession
    toxic = F.col("toxic").cast("int").alias("toxic")
    drawn = labels.where("toxic is not null and doc_id is not null").select("doc_id", toxic)
    drawn = materialize(drawn.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(model.fit_rows), "drawn-labels")
    words = exploded(docs.join(F.broadcast(drawn), "doc_id"), letters(F.col(text_col)), "word", "toxic")
    classes = drawn.select("toxic")
    if url_words is not None:
        judged = materialize(url_labels.where("toxic is not null").select("url", toxic).dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(model.fit_rows), "drawn-urls")
        words = words.unionByName(url_words.join(F.broadcast(judged), "url").select("toxic", "word"))
        classes = classes.unionByName(judged.select("toxic"))
    bad, good = F.when(F.col("toxic") == 1, 1).otherwise(0), F.when(F.col("toxic") == 1, 0).otherwise(1)
    counted = words.groupBy("word").agg(F.sum(bad).alias("bad"), F.sum(good).alias("good"))
    n = model.seed_count
    seeds = [(w, n, 0) for w in model.blocked] + [(w, 0, n) for w in model.allowed]
    counted = counted.unionByName(spark.createDataFrame(seeds, "word string, bad bigint, good bigint"))
    summed = materialize(counted.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "class-counts")
    all_bad, all_good = (float(x or 0) for x in summed.agg(F.sum("bad"), F.sum("good")).first())
    n_bad, n_good = (int(x or 0) for x in classes.agg(F.sum(bad), F.sum(good)).first())
    odds = F.lit(0.0)
    if all_bad and all_good:
        share = all_bad / (all_bad + all_good)
        odds = F.log((F.col("bad") + model.smoothing * share) / (F.col("good") + model.smoothing * (1 - share))) - math.log(all_bad / all_good)
    return summed.select("word", odds.alias("odds")), math.log((n_bad + 1) / (n_good + 1))


def judge(
    pages: DataFrame, docs: DataFrame, labels: DataFrame, rules: list[Rule], model: UrlModel = UrlModel(), url_col: str = "url", text_col: str = "text",
    url_labels: DataFrame | None = None,
) -> DataFrame:
    """``pages`` with a struct ``judged``: ``host, path, rule, verdict, odds``.

    ``labels`` has ``doc_id, toxic`` and ``url_labels``, if given, ``url,
    toxic``; both teach the model. A null URL, or one without ``://``, has an
    empty host and path, no rule and the verdict of the prior. Equal URLs get
    equal verdicts; they are scored once. Long URLs are scored whole. Rows are
    kept as they are, repeated ones too; an empty table gives no rows. Log odds
    are summed exactly alike in any order, as they are rounded before. A column
    named ``judged`` is replaced.
    """
    host_, path_ = host(F.col("url")), path(F.col("url"))
    urls = pages.select(F.coalesce(F.col(url_col), F.lit("")).alias("url")).distinct()
    every = urls if url_labels is None else urls.unionByName(url_labels.where("url is not null").select("url")).distinct()
    # A name counts as often as it occurs in its URL.
    parts = exploded(every, names(host_, path_), "name", "url").groupBy("url", "name").agg(F.count(F.lit(1)).alias("times"))
    counts, total = word_counts(docs, text_col, model)
    split = materialize(segment(parts.select("name").distinct(), counts, total), "split-names")
    taught = parts.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).join(split, "name").select("url", F.explode("words").alias("word"))
    odds, prior = fit(docs, labels, text_col, model, None if url_labels is None else taught, url_labels)
    exact = F.round("odds", 9).cast("decimal(38,9)")
    scored = split.select("name", F.explode("words").alias("word")).join(odds, "word").groupBy("name").agg(F.sum(exact).alias("odds"))
    # Written, as names like "com" are in most URLs: see the last join.
    scored = materialize(scored, "scored-names")
    scores = parts.join(scored, "name").groupBy("url").agg(F.sum(F.col("odds") * F.col("times")).cast("double").alias("odds"))
    key, mark = fresh(pages.columns, "__url", "__judged")
    final = urls.join(scores, "url", "left").select(
        F.col("url").alias(key),
        host_.alias("host"),
        path_.alias("path"),
        ruled(host_, path_, rules).alias("ruled"),
        (F.lit(prior) + F.coalesce("odds", F.lit(0.0))).alias("odds"),
    )
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("odds") > model.bar, "block").otherwise("allow"))
    # Written, so that the join has a plain shuffle on both sides, of which
    # adaptive execution can split the partition of a hot URL.
    final = materialize(final.select(key, F.struct("host", "path", "ruled.rule", verdict.alias("verdict"), "odds").alias(mark)), "judged-urls")
    joined = pages.withColumn(key, F.coalesce(F.col(url_col), F.lit(""))).join(final, key)
    return joined.withColumn("judged", F.col(mark)).drop(key, mark)
