"""Quality rules by weak supervision, with DataFrame functions only.

Each rule looks at a document's counts and votes good (1), bad (0) or abstains
(null). A document's votes form a pattern; the corpus has at most 3^rules
patterns, so expectation-maximisation over the pattern counts (estimating each
rule's accuracy and the shares of good and failing documents) costs the same at any
corpus size. The posterior P(good | votes) replaces "every rule must pass".

Defined results: a null or blank text has no words, fails the base rules and gets
whatever posterior its votes give; repeated rows are scored alike, once per row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.llm.common import SPACE_CHARS, word_array
from chirpflow.session import read_table, scratch_path

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _joined(hashes: Column, gap: int) -> Column:
    """Hash of each element with the one ``gap`` places on: doubles the window width."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + gap)))


def repeat_marks(hashes: Column) -> Column:
    """Sorted (hash, position) of a text's windows; null unless some hash occurs twice
    (most texts stop at that linear test and sort nothing)."""
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p")))))


def repeated_positions(marks: Column) -> Column:
    """Positions, ascending, of the windows whose hash has an equal neighbour."""

    def twin(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(marks, i - 1).getField("h") == x.getField("h"), F.lit(False)) | F.coalesce(
            F.get(marks, i + 1).getField("h") == x.getField("h"), F.lit(False)
        )

    return F.sort_array(F.transform(F.filter(marks, twin), lambda x: x.getField("p")))


def covered_words(positions: Column, window: int = WINDOW) -> Column:
    """Size of the union of [p, p + window) over ascending positions (null: 0)."""
    return F.coalesce(
        F.aggregate(
            positions,
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")),
            lambda acc, p: F.struct(
                (acc.getField("n") + F.least(F.lit(window), p - acc.getField("at"))).alias("n"), p.alias("at")
            ),
            lambda acc: acc.getField("n"),
        ),
        F.lit(0),
    )


def features(docs: DataFrame) -> DataFrame:
    """Per document: the base counts and the ratios the rules look at.

    A repeated window is found by its 64-bit hash among the windows of one text:
    linear work after one sort per text, and no row leaves its document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("_text"))
    d = d.select(
        "doc_id",
        "_text",
        word_array(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        F.translate("_text", SPACE_CHARS, "").alias("_solid"),
    )
    n = F.size("_words")
    d = d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length("_solid").cast("long").alias("word_chars"),
        (F.char_length("_solid") - F.char_length(F.translate("_solid", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.char_length(F.regexp_replace("_solid", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.char_length(F.regexp_replace("_solid", "[^!]+", "")).cast("long").alias("n_marks"),
        F.when(n > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).alias("_hashes"),
    )
    for gap in (1, 2, 4):  # windows of two, four, eight words
        d = d.withColumn("_hashes", _joined(F.col("_hashes"), gap))
    d = d.withColumn("_hashes", F.slice("_hashes", 1, (F.col("n_words") - (WINDOW - 1)).cast("int")))
    d = d.withColumn("_marks", repeat_marks(F.col("_hashes"))).drop("_hashes")
    d = d.withColumn("_hits", repeated_positions(F.col("_marks"))).drop("_marks")
    return d.withColumn("n_repeat_words", covered_words(F.col("_hits")).cast("long")).drop("_hits")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rules() -> dict[str, Column]:
    """Rule name -> vote (1 good, 0 bad, null abstains) over the feature columns."""
    words = F.col("n_words")
    some = words >= 5
    per_word = F.try_divide(F.col("word_chars"), words)
    symbols = F.try_divide(F.col("n_symbols"), words)
    upper = F.try_divide(F.col("n_upper"), F.col("word_chars"))
    marks = F.try_divide(F.col("n_marks"), words)
    dup = F.try_divide(F.col("n_dup_lines"), F.col("n_lines"))
    repeat = F.try_divide(F.col("n_repeat_words"), words)
    distinct = F.try_divide(F.col("n_distinct"), words)
    return {
        "length": _vote(words >= 50, words < 10),
        "word_length": _vote(some & per_word.between(3, 10), some & ~per_word.between(2, 15)),
        "symbols": _vote(some & (symbols < 0.02), some & (symbols > 0.15)),
        "shouting": _vote(some & (upper < 0.15), some & (upper > 0.3)),
        "exclamation": _vote(some & (marks < 0.05), some & (marks > 0.3)),
        "dup_lines": _vote((F.col("n_lines") > 1) & (dup < 0.1), (F.col("n_lines") > 2) & (dup > 0.3)),
        "repeats": _vote((words >= 16) & (repeat < 0.1), (words >= 16) & (repeat > 0.3)),
        "variety": _vote((words >= 50) & (distinct > 0.3), (words >= 20) & (distinct < 0.1)),
    }


def pattern_number(names: list[str]) -> Column:
    """The votes as one number: base 3, below 3^rules."""
    digits = [F.coalesce(F.col(n), F.lit(2)) * 3**i for i, n in enumerate(names)]
    return sum(digits[1:], digits[0]).cast("int")


def vote_patterns(votes: DataFrame, names: list[str]) -> DataFrame:
    return votes.groupBy("pattern", *names).agg(F.count(F.lit(1)).alias("n"))


#: Expected rates of bad votes, among the votes a rule casts: on good documents, on documents
#: of the rule's own failure class, on documents of another failure class; expected share of good ones.
GOOD_RATE, OWN_RATE, OTHER_RATE, GOOD_SHARE = 0.01, 0.9, 0.2, 0.9
#: Weight of these expectations (Beta and Dirichlet priors), in votes per document of the corpus.
GOOD_WEIGHT, OWN_WEIGHT, OTHER_WEIGHT, SHARE_WEIGHT = 0.5, 0.02, 0.005, 0.01
ROUNDS = 100


def class_weights(names: list[str], model: dict) -> Column:
    """Array of P(class) * P(votes | class): the good class first, then one failure class a rule."""
    # rates travel as literal arrays: the plan's code is the same in every round and compiled once

    def values(xs: list[float]) -> Column:
        return F.array(*[F.lit(math.log(x)) for x in xs])

    rates = [(F.col(n), values(model["bad"][n]), values([1 - x for x in model["bad"][n]])) for n in names]

    def weight(k: Column) -> Column:
        log = F.get(values(model["prior"]), k)
        for vote, down, up in rates:
            log = log + F.when(vote == 0, F.get(down, k)).when(vote == 1, F.get(up, k)).otherwise(0.0)
        return F.exp(log)

    return F.transform(F.sequence(F.lit(0), F.lit(len(names))), weight)


def with_posterior(votes: DataFrame, names: list[str], model: dict) -> DataFrame:
    """Adds p_good, P(good | votes) by Bayes; a rule that abstains says nothing."""
    total = F.aggregate("_weights", F.lit(0.0), lambda x, y: x + y)
    weighed = votes.withColumn("_weights", class_weights(names, model))
    return weighed.withColumn("p_good", F.get("_weights", F.lit(0)) / total).drop("_weights")


def start_model(names: list[str]) -> dict:
    """The expected model: what is fitted where there are no documents."""
    own = {n: [GOOD_RATE] + [OWN_RATE if n == k else OTHER_RATE for k in names] for n in names}
    return {"prior": [GOOD_SHARE] + [(1 - GOOD_SHARE) / len(names)] * len(names), "bad": own}


def fit_em(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict:
    """EM over the pattern table (at most 3^rules rows whatever the corpus size, read once).

    Documents fail in several ways that have little to do with each other (repeats, symbol
    litter, shouting), so there is one good class and one failure class for each rule, and
    a rule's accuracy is its rate of bad votes in each class. Rates are taken among the
    votes cast: rules abstain on short texts together, so abstaining is no evidence. The
    expectations enter as Beta and Dirichlet priors that weigh so many votes per document:
    nothing is cut off, and a rule whose votes say otherwise is fitted otherwise. A failure
    class that no document takes keeps its expected rates and loses its share.
    """
    rows = [(tuple(r[n] for n in names), r["n"]) for r in patterns.select("n", *names).collect()]
    # in one order: rules that always agree have classes alike, which rounding alone tells apart
    return em_rounds(sorted(rows, key=str), names, rounds)


def em_rounds(table: list[tuple[tuple, int]], names: list[str], rounds: int = ROUNDS) -> dict:
    """Maximum a posteriori EM on (votes, documents) rows until the rates stand still."""
    start = model = start_model(names)
    total = sum(n for _, n in table)
    if not total:
        return model
    classes = range(len(names) + 1)
    weight = {n: [GOOD_WEIGHT] + [OWN_WEIGHT if n == k else OTHER_WEIGHT for k in names] for n in names}
    for _ in range(rounds):
        mass = [0.0 for _ in classes]
        down = {n: [0.0 for _ in classes] for n in names}
        cast = {n: [0.0 for _ in classes] for n in names}
        for votes, n in table:  # E-step: a pattern's documents shared among the classes
            share = list(model["prior"])
            for name, vote in zip(names, votes, strict=True):
                if vote is not None:
                    rates = model["bad"][name]
                    share = [s * (1 - x if vote else x) for s, x in zip(share, rates, strict=True)]
            scale = n / sum(share)
            for k in classes:
                mass[k] += share[k] * scale
            for name, vote in zip(names, votes, strict=True):
                if vote is not None:
                    for k in classes:
                        cast[name][k] += share[k] * scale
                        down[name][k] += 0.0 if vote else share[k] * scale
        bad = {  # M-step: the expectation counts like so many votes more
            name: [
                (down[name][k] + total * weight[name][k] * start["bad"][name][k]) / (cast[name][k] + total * weight[name][k])
                for k in classes
            ]
            for name in names
        }
        prior = [(m + total * SHARE_WEIGHT * x) / (total * (1 + SHARE_WEIGHT)) for m, x in zip(mass, start["prior"], strict=True)]
        shift = max(abs(x - y) for name in names for x, y in zip(bad[name], model["bad"][name], strict=True))
        model = {"prior": prior, "bad": bad}
        if shift < 1e-7:
            break
    return model


def quality_votes(docs: DataFrame, threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """Features, votes, posterior and verdict per document.

    The features (numbers only) go once to the shared scratch folder, so the texts
    are read once; the fit reads the pattern counts, the result reads the features.
    """
    spark = docs.sparkSession
    votes = rules()
    names = list(votes)
    path = scratch_path(spark, "quality-features")
    features(docs).withColumns(votes).withColumn("pattern", pattern_number(names)).write.parquet(path)
    table = spark.read.parquet(path)
    counts = scratch_path(spark, "quality-patterns")
    vote_patterns(table, names).coalesce(1).write.parquet(counts)
    patterns = spark.read.parquet(counts)
    model = fit_em(patterns, names, rounds)
    scored = with_posterior(patterns, names, model).select("pattern", "p_good")  # at most 3^rules rows
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        table.join(F.broadcast(scored), "pattern")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
