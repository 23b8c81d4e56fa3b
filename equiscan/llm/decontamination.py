"""Benchmark decontamination with a distributed positional inverted index.

The index keeps (document, position) postings of the benchmark terms that can tell a window apart: for every window of an
item the few terms that the fewest items use. Their exact frequencies in the corpus then order the lists of a window, and
lists are intersected from the rarest on, positions shifted by the place of the term in the item. What is left is compared
word for word along the item, which gives every exact window; lists that only meet within a few words are proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscan.llm.columns import row_key, text_or_empty, words_of
from equiscan.session import broadcast_up_to, staged

WINDOW = 13
#: Terms of a window that get postings, and of those the lists that are intersected.
TERMS, LISTS = 4, 3
#: Words by which a term may be off its place in a proximity match.
SLOP = 13
#: Terms and candidate documents that are still broadcast, about 60 bytes and 1 kB each.
BROADCAST_TERMS, BROADCAST_DOCUMENTS = 500_000, 50_000


def window_terms(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, start, place, term) for the :data:`TERMS` terms of each window that the fewest items use.

    ``items`` has item (a key) and words. An item with fewer words than ``window`` is one window.
    """
    n = F.size("words")
    length = F.least(n, F.lit(window))
    placed = items.where(n > 0).select("item", F.posexplode("words").alias("place", "term"), n.alias("n"), length.alias("m"))
    used = placed.groupBy("term").agg(F.countDistinct("item").alias("used"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("m") + 1), F.least("place", F.col("n") - F.col("m")))
    spread = placed.join(used, "term").select("item", "place", "term", "used", F.explode(starts).alias("start"))
    rarest = Window.partitionBy("item", "start").orderBy("used", F.length("term").desc(), "place")
    return spread.withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= TERMS).select("item", "start", "place", "term")


def _lists(terms: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item, p1, t1, p2, t2, p3, t3): the places and terms of each window by frequency in the corpus, rarest first.

    Windows with a term that the corpus lacks cannot occur and are left out; one of fewer terms repeats its last.
    """
    ranked = terms.join(frequency, "term", "left")
    by_rarity = F.array_sort(F.collect_list(F.struct("df", "place", "term"))).alias("l")
    whole = ranked.groupBy("item", "start").agg(by_rarity, F.min(F.col("df").isNotNull()).alias("all")).where("all")
    nth = lambda i: F.element_at("l", F.least(F.lit(i), F.size("l")))
    return whole.select("item", *(nth(i)[f].alias(f"{f[0]}{i}") for i in range(1, LISTS + 1) for f in ("place", "term"))).distinct()


def candidate_places(postings: DataFrame, lists: DataFrame, slop: int = SLOP) -> DataFrame:
    """(key, item, base, exact): where an item could begin; exact if all its lists meet in place."""
    found = postings.select("key", F.col("term").alias("t1"), F.col("position").alias("at1")).join(broadcast_up_to(lists, BROADCAST_TERMS), "t1")
    found = found.withColumn("base", F.col("at1") - F.col("p1"))
    exact = F.lit(True)
    for i in range(2, LISTS + 1):
        other = postings.select(F.col("key").alias("k"), F.col("term").alias("t"), F.col("position").alias("at"))
        off = F.col("at") - F.col("base") - F.col(f"p{i}")
        found = found.join(other, (F.col("key") == F.col("k")) & (F.col(f"t{i}") == F.col("t")) & (F.abs(off) <= slop))
        found = found.withColumn(f"exact{i}", off == 0).drop("k", "t", "at")
        exact = exact & F.col(f"exact{i}")
    return found.groupBy("key", "item", "base").agg(F.max(exact).alias("exact"))


def _occurrence(words: Column, o: Column, window: int) -> Column:
    """Compare an item with the words of a document from ``base`` on: (item_id, positions inside whole windows)."""
    low = F.greatest(F.lit(0), -o["base"])
    high = F.least(F.size(o["words"]), F.size(words) - o["base"])
    part = F.struct(
        F.slice(words, o["base"] + low + 1, F.greatest(high - low, F.lit(0))).alias("d"),
        F.slice(o["words"], low + 1, F.greatest(high - low, F.lit(0))).alias("w"),
        (o["base"] + low).alias("from"),
        F.least(F.size(o["words"]), F.lit(window)).alias("m"),
        o["item_id"].alias("item_id"),
    )

    def positions(x: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(x["d"]) - x["m"], F.lit(0))),
            lambda s: (F.size(x["d"]) >= x["m"]) & (F.slice(x["d"], s + 1, x["m"]) == F.slice(x["w"], s + 1, x["m"])),
        )
        return F.flatten(F.transform(starts, lambda s: F.sequence(x["from"] + s, x["from"] + s + x["m"] - 1)))

    # A list of one, so that the slices are taken once.
    return F.element_at(F.transform(F.array(part), lambda x: F.struct(x["item_id"].alias("item_id"), positions(x).alias("positions"))), 1)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """One row for every row of ``docs``: ``id_col``, n_words, n_hit, n_items, items (ids as sorted strings), contaminated,
    n_near (items whose rarest terms meet within :data:`SLOP` words, though no window occurs).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A document is contaminated if hit
    words are a twentieth of its words or more. Windows are found without loss: a window occurs only where its rarest terms
    stand in place, and each such place is compared word for word.

    Null and empty texts have no words and are clean; items without words have no windows. Repeated rows have equal
    results, repeated items count once, items without id are found but not named. Columns other than those named are not
    read. Empty tables are fine on either side.
    """
    id_key = row_key(F.col(id_col).cast("string"), text_col)
    items = benchmark.select(
        row_key(F.col(item_col).cast("string"), text_col).alias("item"), F.col(item_col).cast("string").alias("item_id"), words_of(text_or_empty(text_col)).alias("words")
    ).dropDuplicates(["item"])
    items = staged(items, "benchmark-items")
    terms = staged(window_terms(items, window), "benchmark-terms")
    vocabulary = broadcast_up_to(terms.select("term").distinct(), BROADCAST_TERMS)
    texts = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"), id_key.alias("key"))
    postings = staged(texts.select("key", F.posexplode(words_of(F.col("text"))).alias("position", "term")).join(vocabulary, "term").select("key", "position", "term"), "benchmark-postings")
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    lists = staged(_lists(terms, frequency), "benchmark-lists")
    places = staged(candidate_places(postings, lists), "benchmark-places")

    named = places.join(broadcast_up_to(items, BROADCAST_TERMS), "item")
    per_document = staged(
        named.groupBy(F.col("key").alias("k")).agg(
            F.collect_list(F.when(F.col("exact"), F.struct("item_id", "words", "base"))).alias("occurrences"), F.collect_set("item_id").alias("met")
        ),
        "benchmark-candidates",
    )
    # Words are split behind the join, so that a shuffle, where the candidates are too many for a broadcast, moves texts.
    joined = texts.join(broadcast_up_to(per_document, BROADCAST_DOCUMENTS), F.col("key") == F.col("k"), "left").withColumn("words", words_of(F.col("text")))
    found = joined.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        "met",
        F.when(
            F.col("k").isNotNull(),
            F.filter(F.transform("occurrences", lambda o: _occurrence(F.col("words"), o, window)), lambda x: F.size(x["positions"]) > 0),
        ).alias("hits"),
    )
    hits = F.coalesce("hits", F.array().cast("array<struct<item_id:string,positions:array<int>>>"))
    result = found.select(
        "doc",
        "n_words",
        F.coalesce("met", F.array().cast("array<string>")).alias("met"),
        F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: x["positions"])))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(hits, lambda x: x["item_id"])))).alias("items"),
    )
    return result.select(
        F.col("doc").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.size(F.array_except("met", "items")).cast("long").alias("n_near"),
    )
