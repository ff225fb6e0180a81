"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions alone.

The index stores a posting (term, row, position) for each token of the training texts that is a word of the benchmark,
and one posting per row with its length. A posting of a word of an item, less the word's offset, says where the item
would begin: its shift. A window (WINDOW consecutive words of an item) matches where its words agree on the shift:
exactly, or, as a proximity match, where OF_TEN of ten of its words have shifts at most DISTANCE from one that may be
any number.

Lists are intersected from the rarest words. If a match may lack m words of a window, two of its m + 2 rarest words are
there, and of all words that are among the rarest of any window of the item, each matching window lacks at most m. So
only those words' postings are looked at first, gathered in cells of shifts that overlap by the distance, and a cell
stays if some window lacks at most m of them there. What stays is checked on all words. Words that the corpus lacks are
the rarest of all and cost nothing. No match is lost, whichever words were changed.

Items and words are known by numbers of written tables, not by hashes.

Defined results: null texts have no words; an item of fewer words than a window, but not none, is one window; items
with the same words are all named; texts of any length are indexed whole; repeated rows, rows of one doc_id and rows
without doc_id are judged each on its own; empty tables give empty or clean results; only doc_id, text, item_id are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import row_number, steady, without_rows, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: A proximity match: words at most so far from their places, and so many of ten (as it rounds up).
DISTANCE, OF_TEN = 3, 8
#: A side of at most so many bytes, by its counted rows and measured words, is sent to all tasks; a longer one is joined by shuffling.
SENT_BYTES = 20_000_000


def words(text: Column) -> Column:
    """The words of a text. lower() is right for ASCII texts, and faster."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.regexp_extract_all(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit(WORD), F.lit(0))


def small(df: DataFrame, more: Column | None = None) -> DataFrame:
    """df (a written table), marked for broadcast if it was measured to be short: 32 bytes a column, and the bytes of `more`."""
    size = F.count("*") * (32 * len(df.columns)) + (F.coalesce(F.sum(more), F.lit(0)) if more is not None else 0)
    return F.broadcast(df) if df.agg(size).first()[0] <= SENT_BYTES else df


def lacking(k: Column) -> Column:
    """How many words a window of k words may lack."""
    return F.floor(k * (10 - OF_TEN) / 10).cast("int")


def numbered(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """names: item, item_id; vocabulary: word, term (the empty word, which ends each text, is -1); places: item, len, off, term.

    An item is a different list of words.
    """
    spark = benchmark.sparkSession
    each = written(benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), words(benchmark["text"]).alias("w")).where("size(w) > 0"), "items")
    lists = written(each.select("w").distinct(), "lists")
    items = lists.select(row_number(lists).alias("item"), "w")
    terms = written(each.select(F.explode("w").alias("word")).distinct(), "terms")
    own = terms.select("word", row_number(terms).alias("term"))
    places = items.select("item", F.size("w").alias("len"), F.posexplode("w").alias("off", "word")).join(own, "word").select("item", "len", "off", "term")
    vocabulary = own.union(spark.range(1).select(F.lit("").alias("word"), F.lit(-1).cast("long").alias("term")))
    return written(each.join(items, "w").select("item", "item_id").distinct(), "names"), written(vocabulary, "vocabulary"), written(places, "places")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term (number; -1: the length of the row), row, doc_id (with the length alone), pos. vocabulary: word, term."""
    w = F.concat(F.coalesce(words(docs["text"]), F.array().cast("array<string>")), F.array(F.lit("")))
    rows = docs.select("doc_id", row_number(docs).alias("row"), w.alias("w"))
    tokens = rows.select("doc_id", "row", F.posexplode("w").alias("pos", "word"))
    return tokens.join(small(vocabulary, F.octet_length("word")), "word").select("term", "row", F.when(F.col("term") == -1, F.col("doc_id")).alias("doc_id"), "pos")


def bit(off: str) -> Column:
    """One of 64 bits. Offsets of one window have different ones."""
    return F.expr(f"shiftleft(1L, {off} % 64)")


def anchored(places: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """item, k (words of its windows), anchors (off, term of words that are among the rarest of a window), windows (bits; need: how many anchors, all: how many words)."""
    known = places.join(counts, "term", "left").select("item", "len", "off", "term", F.coalesce("n", F.lit(0)).alias("n"))
    lists = known.groupBy("item", "len").agg(F.array_sort(F.collect_list(F.struct("off", "n", "term"))).alias("l")).withColumn("k", F.least(F.lit(size), "len"))
    starts = F.sequence(F.lit(0), F.col("len") - F.col("k"))
    rarest = F.transform(starts, lambda i: F.slice(F.array_sort(F.transform(F.slice("l", i + 1, F.col("k")), lambda x: F.struct(x["n"], x["off"], x["term"]))), 1, lacking(F.col("k")) + 2))
    lists = lists.withColumn("anchors", F.array_distinct(F.transform(F.flatten(rarest), lambda x: F.struct(x["off"], x["term"]))))
    marked = lists.withColumn("is_anchor", F.transform("l", lambda x: F.array_contains(F.transform("anchors", lambda a: a["off"]), x["off"])))
    windows = F.transform(starts, lambda i: F.struct(
        F.aggregate(F.slice("l", i + 1, F.col("k")), F.lit(0).cast("long"), lambda b, x: b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["off"] % 64))).alias("bits"),
        (F.size(F.filter(F.slice("is_anchor", i + 1, F.col("k")), lambda x: x)) - lacking(F.col("k"))).alias("need"),
        (F.col("k") - lacking(F.col("k"))).alias("all"),
    ))
    return marked.select("item", "k", "anchors", windows.alias("windows"))


def cells(index: DataFrame, anchors: DataFrame, distance: int) -> DataFrame:
    """item, row, cell, bits: which words (as bits) of an item have postings in a row and cell of shifts.

    Cells are two steps wide and overlap by one, so two shifts of one match are in one cell.
    """
    wide = 2 * distance + 1
    terms = written(anchors.select("term").distinct(), "anchor-terms")
    # by row once: all that follows stays where it is
    postings = index.join(small(terms), "term", "left_semi").select("row", "term", "pos").repartition("row")
    placed = postings.join(small(anchors), "term").select("item", "row", "k", "off", F.floor((F.col("pos") - F.col("off")) / wide).cast("int").alias("cell"))
    both = placed.select("item", "row", "k", bit("off").alias("bit"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    return both.groupBy("item", "row", "cell").agg(F.bit_or("bit").alias("bits"), F.max("k").alias("k")).where(F.bit_count("bits") >= F.least(F.lit(2), "k")).drop("k")


def candidates(index: DataFrame, known: DataFrame, distance: int) -> DataFrame:
    """item, row, cell where some window lacks at most what it may of its anchors; low, high: the first and last offset of such windows."""
    anchors = written(known.select("item", "k", F.explode("anchors").alias("a")).select("item", "k", "a.off", "a.term"), "anchors")
    seen = cells(index, anchors, distance).join(small(known.select("item", "k", "windows"), 24 * F.size("windows")), "item")
    starts = F.filter(F.transform("windows", lambda w, i: F.when(F.bit_count(w["bits"].bitwiseAND(F.col("bits"))) >= w["need"], i)), lambda i: i.isNotNull())
    return seen.select("item", "row", "cell", "k", starts.alias("starts")).where("size(starts) > 0").select("item", "row", "cell", F.array_min("starts").alias("low"), (F.array_max("starts") + F.col("k") - 1).alias("high"))


def matches(index: DataFrame, places: DataFrame, known: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """item, row, shift, k, starts (of the windows that stand there exactly; none for proximity matches alone)."""
    wide = 2 * distance + 1
    found = written(candidates(index, known, distance), "candidates")
    rows = written(found.select("row").distinct(), "rows")
    near = index.where("term >= 0").join(small(rows), "row", "left_semi").select("row", "term", "pos")
    wanted = found.join(small(places.drop("len")), "item").where(F.col("off").between(F.col("low"), F.col("high"))).select("item", "row", "cell", "off", "term")
    shift = F.col("pos") - F.col("off")
    first = wide * (F.col("cell") - 1)  # the cell's shifts begin here, and its matches `distance` before
    met = wanted.join(near, ["row", "term"]).where(shift.between(first - 2 * distance, first + 2 * wide - 1 + 2 * distance)).select("item", "row", "cell", "off", shift.alias("shift"))
    lists = met.groupBy("item", "row", "cell").agg(F.bit_or(bit("off")).alias("bits"), F.collect_set(F.struct("off", "shift")).alias("l"))
    whole = lists.join(small(known.select("item", "k", "windows"), 24 * F.size("windows")), "item").where(F.exists("windows", lambda w: F.bit_count(w["bits"].bitwiseAND(F.col("bits"))) >= w["all"]))
    # which words are within a window of shifts changes only where the window begins at one of them
    each = whole.select("item", "row", "k", "l", F.explode(F.array_distinct(F.transform("l", lambda x: x["shift"]))).alias("shift"))
    offs = lambda most: F.array_sort(F.array_distinct(F.transform(F.filter("l", lambda x: x["shift"].between(F.col("shift"), F.col("shift") + most)), lambda x: x["off"])))
    each = each.select("item", "row", "shift", "k", (F.col("k") - lacking(F.col("k"))).alias("least"), offs(2 * distance).alias("near"), offs(0).alias("there"))
    # sorted offsets, so many of which lie within one window
    within = lambda c, n, k: F.filter(F.transform(c, lambda x, i: F.when(F.get(c, i + n - 1) - x < k, x)), lambda x: x.isNotNull())
    told = each.where(F.size("near") >= F.col("least")).where(F.size(within(F.col("near"), F.col("least"), F.col("k"))) > 0)
    return told.select("item", "row", "shift", "k", within(F.col("there"), F.col("k"), F.col("k")).alias("starts")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs by exact phrases.

    Then n_near_items, near_items: how many items have proximity matches alone there, and their ids, comma-joined.
    """
    return judged(docs, benchmark, size).drop("row")


def judged(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The same with row, the number of each row."""
    names, vocabulary, places = numbered(benchmark)
    index = written(build_index(steady(docs), vocabulary), "index")
    counts = written(index.where("term >= 0").groupBy("term").agg(F.count("*").alias("n")), "counts")
    known = written(anchored(places, counts, size), "anchored")
    found = written(matches(index, places, known), "matches")
    begun = found.select("row", "k", F.explode("starts").alias("start"), "shift").select("row", "k", (F.col("start") + F.col("shift")).alias("at")).distinct()
    covered = begun.select("row", F.explode(F.sequence("at", F.col("at") + F.col("k") - 1)).alias("pos")).distinct()
    hit = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    items = found.groupBy("item", "row").agg(F.max(F.size("starts") > 0).alias("exact")).join(names, "item").groupBy("row", "item_id").agg(F.max("exact").alias("exact"))
    of = lambda told: F.array_join(F.array_sort(F.collect_list(F.when(told, F.col("item_id")))), ",")
    named = items.groupBy("row").agg(F.count_if("exact").alias("n_items"), of(F.col("exact")).alias("items"), F.count_if(~F.col("exact")).alias("n_near_items"), of(~F.col("exact")).alias("near_items"))
    rows = index.where("term = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(hit, "row", "left").join(named, "row", "left").select(
        "row", "doc_id", "n_words", none("n_hit"), none("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        none("n_near_items"), F.coalesce("near_items", F.lit("")).alias("near_items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of the benchmark, in all their columns. Rows are told apart by their numbers."""
    docs = steady(docs)
    return without_rows(docs, judged(docs, benchmark).where("contaminated").select("row"))
