"""SpotSigs document fingerprints in native column expressions.

A signature is the chain of the next ``CHAIN`` content words after a common word (its anchor). The
fingerprint of a text is the set of hashes of its signatures. A text without any chain after an anchor
is its own chain of words, so that every text with words has a signature. Likeness is the Jaccard
coefficient of two fingerprints.

``near_groups`` joins near duplicates: equal sets are one node, sets are partitioned by length so that
only lengths whose ratio allows the threshold meet, a set is looked up by its rarest signatures alone,
and pairs are dropped by their sizes before they are compared.

Null texts are empty; two texts without words are alike (1), one with and one without are not (0). Rows
without an id have no next document and are not one: they are compared with the first. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.components import components
from wardline.session import stage

#: Common words of English, French, Spanish and German that serve as anchors.
ANCHORS = tuple(
    """a an and are as at be by for from has have he in is it not of on or she that the this to was were which with you
    au aux avec ce dans des du elle en est et il je la le les leur mais ne pas pour que qui se sur une
    como con del el esta los más no para pero por su sus
    auf das dem den der des die ein eine er für ich im ist mit nicht sich sie und von zu""".split()
)
CHAIN = 2
#: Ids that fall into one window; the first of each are looked up by the window before.
CHUNK = 1 << 10


def signatures(text: Column) -> Column:
    """The set of signature hashes, as a sorted array of 32-bit numbers; each expression is worked out once."""
    return _let(F.coalesce(text, F.lit("")), _signatures)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, although it is used often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _signatures(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return _let(words, lambda w: F.when(F.size(w) == 0, F.expr("cast(array() as array<int>)")).otherwise(_of_words(w)))


def _of_words(words: Column) -> Column:
    # Places of the content words, from 1; the anchors of one stand between it and the one before.
    content = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: ~F.element_at(words, i).isin(*ANCHORS))

    def chains(places: Column) -> Column:
        def before(place: Column, k: Column) -> Column:
            last = F.when(k == 0, 0).otherwise(F.get(places, k - 1))
            chain = [F.get(words, F.get(places, k + j) - 1) for j in range(CHAIN)]
            return F.when(place - last > 1, F.transform(F.slice(words, last + 1, place - last - 1), lambda a: F.hash(a, *chain)))

        return F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(places, before), F.isnotnull))))

    return _let(_let(content, chains), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.hash(F.array_join(words, " ")))))


def fingerprint(sigs: Column) -> Column:
    """The set in writing: its size, and a hash of its sorted hashes."""
    return F.concat(F.lpad(F.hex(F.size(sigs)), 6, "0"), F.lit("-"), F.md5(F.array_join(sigs, ",").cast("binary")))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard coefficient of two sets of signatures."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def with_next(df: DataFrame, columns: list[str], id_col: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``next_<c>`` for each column: that of the row with the next id; after the last, the first.

    Ids fall into chunks; within a chunk the next row is the one after. The first row of each chunk also
    goes to the chunk before, which is found among the chunks alone, chunk by chunk in the same way.
    """
    ids = df.where(F.col(id_col).isNotNull())
    heads = stage(ids.groupBy(F.expr(f"{id_col} div {chunk}").alias("part")).agg(F.min(id_col).alias("head")), "heads")
    follows = stage(_next_key(heads.select("part"), chunk).join(heads, F.col("next") == heads["part"]).select(F.col("key"), F.col("head")), "next-heads")
    rows = df.withColumns({"__part": F.expr(f"coalesce({id_col} div {chunk}, 0)"), "__guest": F.lit(False)})
    # Only heads travel twice. Where the table of heads is small, Spark broadcasts it by its size.
    guests = df.join(follows, F.col(id_col) == F.col("head")).withColumn("__part", F.col("key")).drop("key", "head").withColumn("__guest", F.lit(True))
    # Rows without an id belong to a window of their own each, and to the first row.
    window = Window.partitionBy("__part").orderBy("__guest", F.col(id_col).asc_nulls_first())
    both = rows.where(F.col(id_col).isNotNull()).unionByName(guests)
    new = {f"next_{c}": F.lead(c).over(window) for c in columns}
    return both.withColumns(new).where(~F.col("__guest")).drop("__part", "__guest")


def _next_key(keys: DataFrame, chunk: int) -> DataFrame:
    """``key, next`` for the distinct numbers of the one column ``part``; after the greatest, the least."""
    span = keys.agg(F.min("part").alias("low"), F.max("part").alias("high")).first()
    if span["low"] is None:
        return keys.select(F.col("part").alias("key"), F.col("part").alias("next"))
    group = F.expr(f"part div {chunk}")
    inside = keys.withColumn("g", group).withColumn("next", F.lead("part").over(Window.partitionBy("g").orderBy("part")))
    known = inside.where("next IS NOT NULL").select(F.col("part").alias("key"), "next")
    ends = inside.where("next IS NULL").select(F.col("part").alias("key"), "g")
    if span["low"] // chunk == span["high"] // chunk:
        return known.unionByName(ends.select("key", F.lit(span["low"]).alias("next")))
    firsts = stage(keys.groupBy(group.alias("g")).agg(F.min("part").alias("first")), "next-groups")
    after = _next_key(firsts.select(F.col("g").alias("part")), chunk)
    following = after.join(firsts, F.col("next") == firsts["g"]).select(after["key"].alias("g"), F.col("first").alias("next"))
    return known.unionByName(ends.join(following, "g").select("key", "next"))


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness and that to the next row's.

    The edited text has the last half of the characters replaced by the first as many of the next text.
    """
    plain = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = plain.withColumn("own", signatures(F.col("text")))
    named = with_next(plain, ["text", "own"], "id")
    if plain.where("id IS NULL").isEmpty():
        rows = named
    else:
        first = plain.where("id IS NOT NULL").orderBy("id").limit(1).select(F.col("text").alias("next_text"), F.col("own").alias("next_own"))
        nameless = plain.where("id IS NULL").join(F.broadcast(first), F.lit(True), "left").withColumns({"next_text": F.coalesce("next_text", "text"), "next_own": F.coalesce("next_own", "own")})
        rows = named.unionByName(nameless)
    n = F.length("text")
    half = F.floor(n / 2)
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half.cast("int")))
    sets = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    made = sets.select(
        "id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array(F.struct("own", signatures(F.col("edited")).alias("edited"), F.col("next_own").alias("next"))).alias("sets"),
    )
    result = F.element_at(
        F.transform(
            "sets",
            lambda s: F.struct(
                fingerprint(s["own"]).alias("fingerprint"),
                fingerprint(s["edited"]).alias("edited_fingerprint"),
                likeness(s["own"], s["edited"]).alias("near_edited"),
                likeness(s["own"], s["next"]).alias("near_next"),
                F.size(s["own"]).alias("n_signatures"),
            ),
        ),
        1,
    )
    return made.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", result.alias("r")).select(id_col, "n_chars", "edited_sha256", "r.*")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per row of ``df``: id, fingerprint, and the least id that links of the threshold or more reach.

    A link needs a shared signature among the first few of both sets, in an order that all sets share:
    of a set of n, those that it can lose and still reach the threshold, and one more. The order is from
    rare to frequent signatures, counted over all sets, so that what many sets share is looked up only
    where sets have little else; signatures of one set alone take places but find nobody.
    """
    rows = stage(df.select(F.col(id_col).cast("long").alias("id"), signatures(F.col(text_col)).alias("sigs")).withColumn("fingerprint", fingerprint(F.col("sigs"))), "spots")
    sets = stage(rows.groupBy("fingerprint").agg(F.min("id").alias("least"), F.first("sigs").alias("sigs")).withColumns({"n": F.size("sigs"), "node": F.xxhash64("fingerprint")}), "spot-sets")
    # Lengths n and m can reach the threshold only if their steps are equal or next to each other.
    step = F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(1 / threshold)).cast("int")
    places = (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")
    spread = sets.where("n > 0").select("node", "n", step.alias("step"), places.alias("places"), F.explode("sigs").alias("s"))
    counts = stage(spread.groupBy("s").count().where("count > 1"), "spot-counts")
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("count"), "s"))), F.lit(1), F.first("places"))
    in_order = spread.join(counts, "s", "left").groupBy("node", "n", "step").agg(first.alias("first"))
    keyed = stage(in_order.select("node", "n", "step", F.explode("first").alias("f")).where("f.count > 1").select("node", "n", "step", "f.s"), "spot-keys")
    # Sets that share a key and a step are candidates; adaptive execution splits a key that many have.
    left = keyed.select(F.col("node").alias("a"), F.col("n").alias("na"), "s", "step")
    right = keyed.select(F.col("node").alias("b"), F.col("n").alias("nb"), "s", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"))
    pairs = left.join(right, ["step", "s"]).where(f"a <> b AND least(na, nb) >= {threshold} * greatest(na, nb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own, other = sets.select(F.col("node").alias("a"), F.col("sigs").alias("x")), sets.select(F.col("node").alias("b"), F.col("sigs").alias("y"))
    links = pairs.join(own, "a").join(other, "b").where(likeness(F.col("x"), F.col("y")) >= threshold).select("a", "b")
    labels = components(links)
    named = sets.select("fingerprint", "node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.select("id", "fingerprint").join(stage(named.join(ids, "label").select("fingerprint", "component_id"), "spot-labels"), "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")
