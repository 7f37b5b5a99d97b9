"""A lexical embedding of texts as sparse vectors, and the exact nearest texts by it.

A text's vector has a weight for each of its terms: its count times the logarithm of how rare it is in the corpus,
scaled to unit length. Vectors are lists of terms, not rows of numbers, so that nothing is hashed and any number of
terms can be told apart.

The search is exact and stops early. A term's greatest weight in any text bounds what it can add to a similarity;
the terms of a question that can add most give a first list of texts, whose *k*-th similarity is a limit. Terms
that could not lift a text to the limit even together are not looked up. The *k*-th similarity without them is a closer
limit, and a text is only compared in full where its similarity so far and what those terms could add reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.text import bind
from wardline.operators.retrieval import TOP_K, rank_found
from wardline.session import stage

WORD = r"[\p{L}\p{Nd}]+"
#: Terms of a question, by what they can add, that the limit is taken from.
SEEDS = 3
#: Terms are not looked up where they add less than this share of the limit, together. With more, fewer texts are looked
#: up and more of them are compared in full; from 1 on the result would not be exact.
SHARE = 0.25


def term_counts(text: Column) -> Column:
    """The different words of a lower-cased text and how often each occurs, in the order of the words."""

    def counted(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

        def runs(begin: Column) -> Column:
            end = F.concat(F.slice(begin, F.lit(2), F.size(begin)), F.array(F.size(words)))
            return F.zip_with(begin, end, lambda a, b: F.struct(F.get(words, a).alias("term"), (b - a).alias("n")))

        return F.when(F.size(words) > 0, bind(starts, runs))

    return bind(F.sort_array(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), counted)


def count_terms(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, counts`` of every text, written once, as fitting and embedding both read it. Null texts have no terms."""
    return stage(texts.select(key, term_counts(F.col(text)).alias("counts")), "term-counts")


def fit_rarity(counted: DataFrame) -> DataFrame:
    """``term, rarity``: ``ln((texts + 1) / (texts with the term + 1))``, for the terms that some text lacks."""
    n = counted.count()
    per_term = counted.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return stage(per_term.where(F.col("df") < n).select("term", F.log((n + 1) / (F.col("df") + 1)).alias("rarity")), "rarity")


def embed_terms(counted: DataFrame, rarity: DataFrame, key: str) -> DataFrame:
    """``key, vector`` (a list of ``term, weight`` of unit length) of the texts that have any weight.

    Rows of one key are one text; terms that the corpus has not are left out.
    """
    long = counted.select(key, F.explode("counts").alias("c")).select(key, "c.term", "c.n")
    # A task holds its share of the terms, so that the texts' words need not be sorted.
    weighed = long.join(rarity.hint("shuffle_hash"), "term").withColumn("weight", F.col("n") * F.col("rarity"))
    one = weighed.groupBy(key).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"), F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("all")
    )
    unit = F.transform("all", lambda t: F.struct(t["term"].alias("term"), (t["weight"] / F.col("length")).alias("weight")))
    return one.select(key, unit.alias("vector"))


def _long(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(key, F.explode("vector").alias("t")).select(key, "t.term", "t.weight")


def lexical_topk(questions: DataFrame, items: DataFrame, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """The exact ``k`` nearest of ``items`` (``item_id, vector``) for each of ``questions`` (``query_id, vector``), ranked.

    Similarities are rounded before they are ranked, ties go to the lower id. Only texts that share a weighted term
    with a question are found; a question may find fewer than ``k``, or none.
    """
    asked = stage(_long(questions, "query_id").withColumnRenamed("weight", "q"), "asked")
    # All that a similarity is made of. The texts' other terms are read once and not kept.
    postings = stage(_long(items, "item_id").join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    most = postings.groupBy("term").agg(F.max("weight").alias("most"))
    # What each term of a question can add at most, and it with all that can add less. As texts have unit length, terms
    # together never add more than the length of the question's weights for them.
    upwards = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    downwards = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.desc("term"))
    bounds = asked.join(most, "term").withColumn("bound", F.col("q") * F.col("most"))
    lengths = F.sqrt(F.sum(F.col("q") * F.col("q")).over(upwards))
    up_to = F.least(F.sum("bound").over(upwards), lengths)
    placed = bounds.withColumns({"up_to": up_to, "length": lengths, "place": F.row_number().over(downwards)})
    terms = stage(placed, "question-terms")

    def partial(some: DataFrame) -> DataFrame:
        found = postings.join(some.select("query_id", "term", "q"), "term")
        shared = F.sum(F.col("weight") * F.col("weight")).alias("shared")
        return found.groupBy("query_id", "item_id").agg(F.sum(F.col("q") * F.col("weight")).alias("similarity"), shared)

    seeded = rank_found(partial(terms.where(F.col("place") <= SEEDS)), k).where(F.col("rank") == k)
    # Rounding may lift what is less than a unit of the last digit below the limit.
    slack = 2.0 * 10.0**-digits
    limits = stage(seeded.select("query_id", (F.col("similarity") - slack).alias("limit")), "limits")
    # Stored, so that Spark knows their size and sends few terms to the postings instead of shuffling these.
    limited = stage(terms.join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(0.0))), "limited-terms")
    left_out = F.col("up_to") < SHARE * F.col("limit")
    rest = limited.groupBy("query_id").agg(
        F.max("limit").alias("limit"), *[F.coalesce(F.max(F.when(left_out, F.col(c))), F.lit(0.0)).alias(n) for c, n in (("up_to", "rest"), ("length", "lacking"))]
    )
    reached = stage(partial(limited.where(~left_out)).join(rest, "query_id"), "reached")
    # With most terms looked up, the k-th similarity so far is a closer limit than that of the first terms. Where it is
    # not above that one, it limits nothing.
    ranked = rank_found(reached.where(F.col("similarity") > F.col("limit")), k).where(F.col("rank") == k)
    closer = stage(ranked.select("query_id", (F.col("similarity") - slack).alias("closer")), "closer")
    # What a text has of its unit length outside the terms that were looked up bounds the others too.
    most_left = F.least("rest", F.col("lacking") * F.sqrt(F.greatest(1 - F.col("shared"), F.lit(0.0))))
    near = reached.join(closer, "query_id", "left").where(F.col("similarity") + most_left >= F.greatest("limit", "closer"))
    compared = stage(near.select("query_id", "item_id"), "compared")
    scores = (
        compared.join(postings, "item_id")
        .join(asked, ["query_id", "term"])
        .groupBy("query_id", "item_id")
        .agg(F.round(F.sum(F.col("q") * F.col("weight")), digits).alias("similarity"))
    )
    return rank_found(scores, k)
