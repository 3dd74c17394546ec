"""Predictions against gold: set counts, smoothed and strict scores, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def smoothed(pred: Column, gold: Column, correct: Column) -> list[Column]:
    """P = c/(pred+1), R = (c+1)/(gold+1), F1 = 2PR/(P+R): never divides by zero."""
    c, p, g = (x.cast("double") for x in (correct, pred, gold))
    precision, recall = c / (p + 1), (c + 1) / (g + 1)
    return [precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall)).alias("f1")]


def strict(pred: Column, gold: Column, correct: Column) -> list[Column]:
    """Unsmoothed scores; null where a denominator is zero."""
    p, r = F.try_divide(correct.cast("double"), pred), F.try_divide(correct.cast("double"), gold)
    return [p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1")]


def value_sets(mentions: DataFrame) -> DataFrame:
    """``(doc_id, category, values)``: the distinct non-empty values."""
    return mentions.where("value is not null and value <> ''").groupBy("doc_id", "category").agg(F.collect_set("value").alias("values"))


def counts(pred: DataFrame, gold: DataFrame, to_set: bool = True, gate: DataFrame | None = None, each: bool = False) -> DataFrame:
    """``(category, pred, gold, correct)`` summed over documents.

    Both inputs are mentions ``(doc_id, category, value)``. With ``to_set`` equal
    values of a document count once; without it duplicates count on either side
    while the intersection stays a set, or with ``each`` every prediction of a gold
    value is correct, a repeated one again. ``gate`` is a second gold labelling: only
    documents and categories where it is not empty and equal to ``gold`` count."""

    def side(m: DataFrame, name: str) -> DataFrame:
        m = m.where("value is not null and value <> ''").groupBy("doc_id", "category", "value").agg(F.count("*").alias(name))
        return m.withColumn(name, F.lit(1)) if to_set else m

    both = side(pred, "p").join(side(gold, "g"), ["doc_id", "category", "value"], "full_outer")
    if gate is not None:
        g = side(gold, "g").join(side(gate, "t"), ["doc_id", "category", "value"], "full_outer")
        same = g.groupBy("doc_id", "category").agg(F.every(F.col("g").isNotNull() & F.col("t").isNotNull()).alias("same")).where("same")
        both = both.join(same, ["doc_id", "category"], "left_semi")
    return both.groupBy("category").agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("pred"), F.coalesce(F.sum("g"), F.lit(0)).alias("gold"),
        F.coalesce(F.sum(F.when(F.col("g").isNotNull(), F.col("p") if each else F.when(F.col("p").isNotNull(), 1))), F.lit(0)).alias("correct"),
    )


def with_overall(by_category: DataFrame, label: str = "overall") -> DataFrame:
    """The rows by category and their micro sum under ``label``."""
    cols = [F.sum(c).alias(c) for c in ("pred", "gold", "correct")]
    return by_category.rollup("category").agg(*cols).withColumn("category", F.coalesce("category", F.lit(label)))


def report(by_category: DataFrame) -> DataFrame:
    """Smoothed precision, recall and F1 of counts."""
    return by_category.select("category", "pred", "gold", "correct", *smoothed(F.col("pred"), F.col("gold"), F.col("correct")))


def averages(by_category: DataFrame) -> DataFrame:
    """``(category, precision, recall, f1, support)`` of counts, unsmoothed and 0 where
    nothing was predicted or marked, with the rows ``micro avg`` (of the summed counts)
    and ``macro avg`` (means weighted by the number marked)."""
    def scored(df: DataFrame) -> DataFrame:
        cols = [F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(strict(F.col("pred"), F.col("gold"), F.col("correct")), ("precision", "recall", "f1"))]
        return df.select("category", *cols, F.col("gold").alias("support"))

    each = scored(by_category)
    micro = scored(with_overall(by_category, "micro avg").where("category = 'micro avg'"))
    weighted = [F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]
    macro = each.agg(*weighted, F.sum("support").alias("support")).select(F.lit("macro avg").alias("category"), "precision", "recall", "f1", "support")
    return each.unionByName(micro).unionByName(macro)


def mean_loss(df: DataFrame, loss: str, steps: str | None = None) -> DataFrame:
    """``(n, mean_loss)``: the mean of a column of losses, of its totals over ``steps`` if given;
    null losses do not count."""
    n = F.count(loss) if steps is None else F.sum(F.when(F.col(loss).isNotNull(), F.col(steps)))
    return df.agg(n.alias("n"), F.try_divide(F.sum(loss), n).alias("mean_loss"))


def medians(df: DataFrame, key: str, value: str, bins: int = 65_536) -> DataFrame:
    """``(key, median)``, exact, without holding the values of a key in one task.

    Values are counted in equal bins between a key's extremes; only the one or
    two bins that hold the middle ranks are then looked at value by value."""
    v = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("k is not null and v is not null")
    ends = v.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    b = v.join(ends, "k").select("k", "v", "n", part.cast("int").alias("b"))
    counts = b.groupBy("k", "n", "b").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("k").orderBy("b"))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    middle = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c")).where((F.col("before") <= high) & (F.col("upto") > low))
    values = b.join(middle.select("k", "b", "before"), ["k", "b"]).groupBy("k", "n", "b", "before", "v").agg(F.count("*").alias("c"))
    rank = F.sum("c").over(Window.partitionBy("k", "b").orderBy("v")) + F.col("before")
    hit = values.withColumn("upto", rank).withColumn("from", F.col("upto") - F.col("c"))
    at = lambda r: F.max(F.when((F.col("from") <= r) & (F.col("upto") > r), F.col("v")))
    return hit.groupBy("k").agg(((at(low) + at(high)) / 2).alias("median")).withColumnRenamed("k", key)


def latency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Number, mean, extremes and exact median of ``value`` per ``key``."""
    v = F.col(value)
    plain = df.where(v.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))
    return plain.join(medians(df, key, value), key, "left")


def log_seconds(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(level, logger, seconds)`` of service-log lines ``date - level - logger - message``
    whose message ends in a number of seconds, all digits of it."""
    part = F.regexp_extract(F.col(column), r"^\S+ \S+ - (\w+) - (\S+) - ", 1)
    logger = F.regexp_extract(F.col(column), r"^\S+ \S+ - (\w+) - (\S+) - ", 2)
    number = F.regexp_extract(F.col(column), r"([0-9]+\.[0-9]+)\s*s?$", 1)
    return lines.select(part.alias("level"), logger.alias("logger"), F.when(number != "", number.cast("double")).alias("seconds")).where("seconds is not null")
