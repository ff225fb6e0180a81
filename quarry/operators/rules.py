"""Market baskets: supports, pair rules, frequent itemsets, recommendations. A basket is a set of items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import one_row, ratio
from quarry.sources.shared import written

#: Items of a block of a large basket, about.
BLOCK = 1000


def bought(df: DataFrame, tx: str, item: str) -> DataFrame:
    """Distinct tx, item without nulls."""
    return df.select(F.col(tx).alias("tx"), F.col(item).alias("item")).where("tx IS NOT NULL AND item IS NOT NULL").distinct()


def baskets(df: DataFrame, tx: str, item: str) -> DataFrame:
    """tx, items (sorted), size. Rows are dealt out by basket once."""
    each = df.select(F.col(tx).alias("tx"), F.col(item).alias("item")).where("tx IS NOT NULL AND item IS NOT NULL").repartition("tx").distinct()
    return each.groupBy("tx").agg(F.sort_array(F.collect_list("item")).alias("items")).withColumn("size", F.size("items").cast("long"))


def at_least(pairs: DataFrame, minimum: float) -> DataFrame:
    """n_tx (baskets with an item) and least (the minimum as a count: a fraction f of them is ceil(f n)), in one row."""
    n = pairs.agg(F.count_distinct("tx").alias("n_tx"))
    return one_row(n.withColumn("least", F.ceil(F.lit(minimum) * F.col("n_tx")) if minimum < 1 else F.lit(int(minimum)).cast("long")))


def item_support(df: DataFrame, tx: str, item: str, minimum: float) -> DataFrame:
    """item, n, support of items in at least `minimum` baskets (a count, or a fraction below 1)."""
    pairs = bought(df, tx, item)
    counts = pairs.groupBy("item").agg(F.count("*").alias("n"))
    return counts.crossJoin(at_least(pairs, minimum)).where("n >= least").select("item", "n", ratio(F.col("n"), F.col("n_tx")).alias("support"))


def grouped(kept: DataFrame) -> DataFrame:
    """items (sorted) of each basket. kept: distinct tx, item."""
    return kept.groupBy("tx").agg(F.sort_array(F.collect_list("item")).alias("items")).select("items")


def pairs_within(baskets_: DataFrame) -> DataFrame:
    """a < b of the sorted items of each basket, made in place."""
    return baskets_.select("items", F.posexplode("items").alias("__at", "a")).select("a", F.explode(F.slice("items", F.col("__at") + 2, F.size("items"))).alias("b"))


def pair_counts(kept: DataFrame, block: int) -> DataFrame:
    """a < b, n: in how many baskets both are. kept: distinct tx, item.

    A basket is paired in place, so its pairs are counted before any shuffle. The items of a basket of more than `block`
    are dealt into blocks by hash; each two blocks of it are a key of their own, so no task pairs more than block^2 or so
    items of one basket, and every pair still meets once.
    """
    sizes = kept.groupBy("tx").agg(F.count("*").alias("__size")).where(F.col("__size") > block)
    side = lambda df, name, *more: df.select("tx", *more, F.col("item").alias(name))
    large = written(sizes, "large-baskets")
    if large.isEmpty():
        return pairs_within(grouped(kept)).groupBy("a", "b").agg(F.count("*").alias("n"))
    met = pairs_within(grouped(kept.join(large, "tx", "left_anti")))
    many = kept.join(large, "tx").withColumn("__blocks", F.ceil(F.col("__size") / block)).withColumn("__own", F.pmod(F.xxhash64("item"), F.col("__blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))
    dealt = many.withColumn("__other", other).withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")})
    left = side(dealt.where(F.col("__own") == F.col("__i")), "x", "__i", "__j")
    right = side(dealt.where(F.col("__own") == F.col("__j")), "y", "__i", "__j")
    # a block meets itself in both orders, and another one once
    pairs = left.join(right, ["tx", "__i", "__j"]).where("(__i = __j AND x < y) OR (__i < __j AND x <> y)")
    return met.unionByName(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))


def counted(df: DataFrame, tx: str, item: str, minimum: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Baskets (distinct tx, item; written once), one row of n_tx and least, and the frequent items with their counts."""
    pairs = written(bought(df, tx, item), "baskets")
    limits = at_least(pairs, minimum)
    items = pairs.groupBy("item").agg(F.count("*").alias("n")).crossJoin(limits).where("n >= least").select("item", "n", ratio(F.col("n"), F.col("n_tx")).alias("support"))
    return pairs, limits, written(items, "items")


def frequent_pairs(pairs: DataFrame, limits: DataFrame, items: DataFrame, block: int) -> DataFrame:
    kept = pairs.join(items.select("item"), "item", "left_semi")
    return pair_counts(kept, block).crossJoin(limits).where("n >= least").select("a", "b", "n", ratio(F.col("n"), F.col("n_tx")).alias("support"))


def pair_support(df: DataFrame, tx: str, item: str, minimum: float, block: int = BLOCK) -> DataFrame:
    """a < b, n, support of pairs in at least `minimum` baskets; rare items are dropped before the self-join."""
    return frequent_pairs(*counted(df, tx, item, minimum), block)


def measures(joint: str, left: str, right: str) -> list:
    """confidence, lift, leverage, conviction (null at confidence 1) from three supports."""
    s, a, b = F.col(joint), F.col(left), F.col(right)
    confidence = ratio(s, a)
    return [confidence.alias("confidence"), ratio(s, a * b).alias("lift"), (s - a * b).alias("leverage"), ratio(1 - b, 1 - confidence).alias("conviction")]


def pair_rules(df: DataFrame, tx: str, item: str, minimum: float, block: int = BLOCK) -> DataFrame:
    """antecedent, consequent, n, support, confidence, lift, leverage, conviction of both directions of each frequent pair. Baskets are made once."""
    known = counted(df, tx, item, minimum)
    pairs, single = frequent_pairs(*known, block), known[2]
    left = single.select(F.col("item").alias("a"), F.col("support").alias("left"))
    right = single.select(F.col("item").alias("b"), F.col("support").alias("right"))
    told = pairs.join(left, "a").join(right, "b")
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("antecedent"), F.col(y).alias("consequent"), F.col(u).alias("left"), F.col(v).alias("right")) for x, y, u, v in (("a", "b", "left", "right"), ("b", "a", "right", "left"))]))
    return told.select("n", "support", ways.alias("w")).select("n", "support", "w.*").select("antecedent", "consequent", "n", "support", *measures("support", "left", "right"))


def extended(found: DataFrame) -> DataFrame:
    """items, rest (what the basket has after them) with one more item, for each of rest."""
    each = found.where(F.size("rest") > 0).select("items", "rest", F.posexplode("rest").alias("__at", "__item"))
    return each.select(F.concat("items", F.array("__item")).alias("items"), F.slice("rest", F.col("__at") + 2, F.size("rest")).alias("rest"))


def itemsets(df: DataFrame, tx: str, item: str, minimum: float) -> tuple[DataFrame, DataFrame]:
    """items (sorted array), n of all itemsets in at least `minimum` baskets, written by size, and the row of at_least.

    Sets grow item by item within the baskets' frequent items: a set is extended where it is in a basket and frequent, and
    counted in place before the shuffle. A set can only be frequent if it is so without its first item, too.
    """
    pairs, limits, single = counted(df, tx, item, minimum)
    kept = written(grouped(pairs.join(single.select("item"), "item", "left_semi")), "frequent-baskets")
    levels = [single.select(F.array("item").alias("items"), "n")]
    found = extended(kept.select(F.array().cast(kept.schema["items"].dataType).alias("items"), F.col("items").alias("rest")))
    while True:
        known = levels[-1].select("items")
        longer = extended(found)
        size = len(levels) + 1
        if size > 2:
            longer = longer.join(known.select(F.col("items").alias("__tail")), F.slice("items", 2, size - 1) == F.col("__tail"), "left_semi")
        counts = longer.groupBy("items").agg(F.count("*").alias("n"))
        level = written(counts.crossJoin(limits).where("n >= least").select("items", "n"), f"itemsets-{size}")
        if level.isEmpty():
            break
        levels.append(level)
        found = longer.join(level.select("items"), "items", "left_semi")
    return reduce(DataFrame.unionByName, levels), limits


def frequent_itemsets(df: DataFrame, tx: str, item: str, minimum: float) -> DataFrame:
    """items (sorted), size, n, support of all itemsets in at least `minimum` baskets."""
    sets, limits = itemsets(df, tx, item, minimum)
    return sets.crossJoin(limits).select("items", F.size("items").alias("size"), "n", ratio(F.col("n"), F.col("n_tx")).alias("support"))


def itemset_rules(df: DataFrame, tx: str, item: str, minimum: float, confidence: float) -> DataFrame:
    """antecedent (array), consequent, and the measures of pair_rules, of rules with one consequent."""
    found, limits = itemsets(df, tx, item, minimum)
    sets = written(found.crossJoin(limits).select("items", "n", ratio(F.col("n"), F.col("n_tx")).alias("support")), "itemsets")
    each = sets.where(F.size("items") > 1).select("n", "support", "items", F.explode("items").alias("consequent"))
    each = each.select("n", "support", F.array_remove("items", F.col("consequent")).alias("antecedent"), "consequent")
    left = sets.select(F.col("items").alias("antecedent"), F.col("n").alias("__n"), F.col("support").alias("left"))
    right = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("support").alias("right"))
    rules = each.join(left, "antecedent").where(F.col("n") / F.col("__n") >= confidence).join(right, "consequent")
    return rules.select("antecedent", "consequent", "support", *measures("support", "left", "right"))


def recommend(baskets_: DataFrame, rules: DataFrame, n: int) -> DataFrame:
    """tx, item, score, place: the best consequents (by confidence, then name) of items in each basket that it lacks.

    No more than n of what an item offers and its basket lacks can be among the basket's best n, and these are among the
    first n + size of the item's list. So a basket's rows are bounded by n times its size, however many rules there are.
    """
    best = written(rules.groupBy("antecedent", F.col("consequent").alias("item")).agg(F.max("confidence").alias("score")), "best-rules")
    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "item")))
    offers = written(best.groupBy("antecedent").agg(listed["item"].alias("__offered")), "offers")
    each = baskets_.select("tx", "items", F.explode("items").alias("antecedent")).join(offers, "antecedent")
    lacking = F.slice(F.array_except(F.slice("__offered", 1, F.size("items") + n), "items"), 1, n)
    offered = each.select("tx", "antecedent", F.explode(lacking).alias("item")).join(best, ["antecedent", "item"])
    new = offered.groupBy("tx", "item").agg(F.max("score").alias("score"))
    return new.withColumn("place", F.row_number().over(Window.partitionBy("tx").orderBy(F.col("score").desc(), "item"))).where(F.col("place") <= n)
