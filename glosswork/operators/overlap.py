"""Joins of texts with passages by shared words: containment and token overlap.

Both name a few rare words of each passage. A text that holds the passage, or
enough of it, holds enough of these words, so an equi-join on words finds every
candidate and only candidates are compared in full. How rare a word is comes
from a sample of the texts: any order of words gives the same result, a good one
gives few candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.session import written

#: One text in so many is counted for the order of words.
SAMPLE = 16
#: Named words of a passage that a text must hold, where the passage has as many to spare.
NAMED = 3


def words_of(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _ranked(words: DataFrame, texts: DataFrame) -> DataFrame:
    """words (_item, _word) with place: 0 for the rarest word of the item."""
    some = texts.where(F.pmod(F.xxhash64("_key"), F.lit(SAMPLE)) == 0).select(F.explode(F.array_distinct(words_of(F.col("_text")))).alias("_word"))
    counts = some.join(words.select("_word").distinct(), "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_count"))
    met = words.join(counts, "_word", "left").withColumn("_count", F.coalesce("_count", F.lit(0)))
    order = Window.partitionBy("_item").orderBy("_count", "_word")
    return met.select("_item", "_word", (F.row_number().over(order) - 1).alias("place"))


def _met(texts: DataFrame, named: DataFrame) -> DataFrame:
    """_key, _item, c: how many of an item's named words (_item, _word) each text holds, if any."""
    own = texts.select("_key", F.explode(F.array_distinct(words_of(F.col("_text")))).alias("_word"))
    return own.join(named, "_word").groupBy("_key", "_item").agg(F.count("*").alias("c"))


def _sides(docs: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return texts, passages.select(F.col(item).alias("_item"), F.lower(F.coalesce(F.col(passage), F.lit(""))).alias("_p"))


def overlapping(docs: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str, threshold: float) -> DataFrame:
    """key, item, overlap for every text that holds at least threshold of the passage's distinct words.

    A passage of n words needs o = ceil(threshold n) of them. Of its n - o + l
    rarest words a text must hold l, and it must have o words at all; pairs that
    may do so are compared by their sets of words. Null texts have no words, a
    passage without words meets nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    texts, items = _sides(docs, passages, key, text, item, passage)
    sets = items.select("_item", F.array_distinct(words_of(F.col("_p"))).alias("_set")).withColumn("n", F.size("_set")).where("n > 0")
    rough = F.ceil(F.lit(threshold) * F.col("n"))
    # The least number whose share reaches the threshold as a double.
    need = F.when((rough - 1) / F.col("n") >= threshold, rough - 1).when(rough / F.col("n") < threshold, rough + 1).otherwise(rough)
    spare = F.least(F.lit(NAMED), "need")
    sets = written(sets.withColumn("need", need.cast("int")).withColumn("least", spare.cast("int")), "passages")
    ranked = _ranked(sets.select("_item", F.explode("_set").alias("_word")), texts)
    named = ranked.join(sets.select("_item", "n", "need", "least"), "_item").where(F.col("place") < F.col("n") - F.col("need") + F.col("least")).select("_item", "_word")
    met = _met(texts, written(named, "named")).join(sets.select("_item", "least", "need"), "_item").where("c >= least").select("_key", "_item", "need")
    own = texts.join(met.select("_key").distinct(), "_key", "left_semi").select("_key", F.array_distinct(words_of(F.col("_text"))).alias("_words"))
    pairs = own.join(met, "_key").where(F.size("_words") >= F.col("need")).join(sets.select("_item", "_set", "n"), "_item")
    shared = F.size(F.array_intersect("_words", "_set"))
    found = pairs.select("_key", "_item", (shared / F.col("n")).alias("overlap")).where(F.col("overlap") >= threshold)
    return found.distinct().select(F.col("_key").alias(key), F.col("_item").alias(item), "overlap")


def contained(docs: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str) -> DataFrame:
    """key, item for every passage that is a substring of a text, whatever the case.

    All words of a passage but its first and last stand whole in such a text, so
    the text holds the rarest of them. The longest part of a passage without such
    words stands inside a word of the text: those passages are looked up among
    the distinct words of all texts. A passage of white space alone meets every
    text; a null one is empty.
    """
    texts, items = _sides(docs, passages, key, text, item, passage)
    all_words = F.split("_p", r"\s+")
    items = items.select("_item", "_p", F.array_distinct(F.slice(all_words, F.lit(2), F.greatest(F.size(all_words) - 2, F.lit(0)))).alias("_inner"))
    longest = F.array_max(F.transform(words_of(F.col("_p")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    items = written(items.withColumn("_part", F.when(F.size("_inner") == 0, longest)), "passages")
    ranked = _ranked(items.select("_item", F.explode("_inner").alias("_word")), texts)
    named = written(ranked.where(F.col("place") < NAMED).select("_item", "_word"), "named")
    counts = named.groupBy("_item").agg(F.count("*").alias("all"))
    met = _met(texts, named).join(counts, "_item").where("c = all").select("_key", "_item")
    short = items.where("_part is not null")
    if not short.isEmpty():
        vocabulary = written(texts.select(F.explode(F.array_distinct(words_of(F.col("_text")))).alias("_word")).distinct(), "vocabulary")
        inside = vocabulary.join(short.select("_item", "_part"), F.col("_word").contains(F.col("_part"))).select("_item", "_word")
        met = met.unionByName(_met(texts, written(inside, "inside")).select("_key", "_item"))
    hits = texts.select("_key", F.lower("_text").alias("_t")).join(met, "_key").join(items.select("_item", "_p"), "_item")
    hits = hits.where(F.col("_t").contains(F.col("_p"))).select("_key", "_item")
    blank = items.where("size(_inner) = 0 and _part is null").select("_item", "_p")
    if not blank.isEmpty():
        hits = hits.unionByName(texts.join(blank, F.lower("_text").contains(F.col("_p"))).select("_key", "_item"))
    return hits.distinct().select(F.col("_key").alias(key), F.col("_item").alias(item))
