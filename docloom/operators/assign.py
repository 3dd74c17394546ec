"""Mentions to categories: grouping, completeness, de-duplication, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import without
from docloom.schemas import LINE_BREAK

# --- fixed values: words removed from values of age, sex and bed number -------
STOP_WORDS = ("病区", "病房", "岁", "床")


def in_order(value: Column, *order: Column) -> Column:
    """Values of a group as an array in the given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("__v")))), lambda x: x["__v"])


def contained_out(values: Column) -> Column:
    """Without values that another value of the list contains.

    Equal values at different positions contain each other and both go. Lists
    of up to one value are left alone."""
    kept = F.filter(
        values, lambda x, i: ~F.exists(F.transform(values, lambda y, j: F.struct(y.alias("v"), j.alias("j"))), lambda y: (y["j"] != i) & F.contains(y["v"], x))
    )
    return F.when(F.size(values) > 1, kept).otherwise(values)


def by_category(mentions: DataFrame, categories: DataFrame) -> DataFrame:
    """``(doc_id, category, values)`` complete over the categories of the task.

    Values are upper-cased, cleaned of stop words in sex, age and bed number,
    non-empty and in order; a category without values gets an empty array."""
    v = F.upper("value")
    for w in STOP_WORDS:
        v = F.when(F.col("category").isin("age", "sex", "bed_number"), F.replace(v, F.lit(w), F.lit(""))).otherwise(v)
    m = mentions.select("doc_id", "task", "category", "pos", "mention_id", v.alias("value")).where("value <> ''")
    grouped = m.groupBy("doc_id", "task", "category").agg(in_order(F.col("value"), F.col("pos"), F.col("mention_id")).alias("values"))
    docs = mentions.select("doc_id", "task").distinct()
    full = docs.join(categories.select("task", "category"), "task")
    return full.join(grouped, ["doc_id", "task", "category"], "left").select(
        "doc_id", "task", "category", F.coalesce("values", F.array().cast("array<string>")).alias("values")
    )


def skipped(mentions: DataFrame, part: str = "Fee") -> DataFrame:
    """Without the categories that hold ``part``: amounts never come from running text."""
    return mentions.where(~F.contains(F.coalesce("category", F.lit("")), F.lit(part)))


def unknown_categories(mentions: DataFrame, categories: DataFrame) -> DataFrame:
    """Mentions of a category that their task does not have."""
    return mentions.join(categories.select("task", "category"), ["task", "category"], "left_anti")


def first_seen(mentions: DataFrame) -> DataFrame:
    """``(doc_id, category, value, first_pos)``: distinct values with the position first seen."""
    return mentions.where("value is not null").groupBy("doc_id", "category", "value").agg(F.min("pos").alias("first_pos"))


def case_variants_out(values: DataFrame) -> DataFrame:
    """``(doc_id, value)`` without variants of fewer capitals; ties stay."""
    capitals = F.length(F.regexp_replace("value", "[^A-Z]", ""))
    v = values.select("doc_id", "value").distinct().withColumn("__c", capitals).withColumn("__l", F.lower("value"))
    best = v.groupBy("doc_id", "__l").agg(F.max("__c").alias("__c"))
    return v.join(best, ["doc_id", "__l", "__c"]).select("doc_id", "value")


#: Characters of which a value may hold none (fixed values): a zero-width space, curly
#: quotation marks, a no-break and an ideographic space.
ODD = "[\u200b“”\u00a0\u3000]"


def train_values_out(values: DataFrame, seen: DataFrame, odd: str = ODD) -> DataFrame:
    """Without one-character values, values with odd characters and values seen in training."""
    return values.where((F.length("value") > 1) & ~F.col("value").rlike(odd)).join(seen.select("value").distinct(), "value", "left_anti")


def cleaned_values(values: DataFrame, seen: DataFrame) -> DataFrame:
    """``(doc_id, value)``: the distinct values of each document as they are kept.

    Full stops and corner brackets go, of variants in capitals and small letters the one
    with more capitals stays, a value within another of its document (whatever the
    letters' case) goes, and so do single characters, values with odd characters and
    values seen in training. A value within another is found by an equi-join on three
    letters, so that a document with very many values is never held in one task."""
    v = values.where("value is not null").select("doc_id", without(F.col("value")).alias("value")).where("value <> ''")
    v = case_variants_out(v).withColumn("__l", F.lower("value"))
    n = F.length("__l")
    # the first letters of the shorter value (padded if it is very short) stand in the longer one
    head = F.rpad(F.substring("__l", 1, 3), 3, "\0")
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.col("__l"), i, F.lit(3)))
    short = F.transform(F.sequence(F.lit(1), n), lambda i: F.rpad(F.substr(F.col("__l"), i, F.lit(2)), 3, "\0"))
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.rpad(F.substr(F.col("__l"), i, F.lit(1)), 3, "\0"))
    longer = v.select("doc_id", F.col("value").alias("__o"), F.col("__l").alias("__ol"), F.explode(F.array_distinct(F.concat(every, short, single))).alias("__g"))
    within = v.withColumn("__g", head).join(longer, ["doc_id", "__g"]).where(F.contains("__ol", F.col("__l")) & (F.col("value") != F.col("__o")))
    kept = v.select("doc_id", "value").join(within.select("doc_id", "value").distinct(), ["doc_id", "value"], "left_anti")
    return train_values_out(kept, seen)


def answers(assigned: DataFrame) -> DataFrame:
    """``(doc_id, task, category, answer)``: values joined by a blank, the
    line-break word as a newline; every category is there."""
    text = F.array_join("values", " ")
    return assigned.select("doc_id", "task", "category", F.regexp_replace(text, f"(?i){LINE_BREAK}", "\n").alias("answer"))


def responses(answered: DataFrame, code: str = "200", message: str = "success") -> DataFrame:
    """``(doc_id, task, response)``: the answers as one JSON object; carets
    become blanks."""
    entries = F.array_sort(F.collect_list(F.struct("category", "answer")))
    body = F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.map_from_entries("__e").alias("result"))
    return answered.groupBy("doc_id", "task").agg(entries.alias("__e")).select("doc_id", "task", F.translate(F.to_json(body), "^", " ").alias("response"))


def packed(mentions: DataFrame, sep: str = "+=+") -> DataFrame:
    """Mentions as packed strings ``category+=+value``."""
    return mentions.select("doc_id", F.concat_ws(sep, "category", "value").alias("packed"))


def unpacked(df: DataFrame, sep: str = "+=+") -> DataFrame:
    at = F.instr("packed", sep)
    return df.select("doc_id", F.expr(f"substring(packed, 1, instr(packed, '{sep}') - 1)").alias("category"), F.expr(f"substring(packed, instr(packed, '{sep}') + {len(sep)})").alias("value")).where(at > 0)


def positions(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """Where each value first stands in its document's text, from 0; null if nowhere."""
    j = mentions.join(texts, "doc_id")
    at = F.expr("instr(text, value)")
    return j.select(*mentions.columns, F.when(at > 0, at - 1).alias("text_pos"))


def wide(assigned: DataFrame, categories: list[str], sep: str = "@#") -> DataFrame:
    """One row per document with a column per category, values joined by ``sep``."""
    return assigned.groupBy("doc_id").pivot("category", categories).agg(F.array_join(F.flatten(F.collect_list("values")), sep))


def mentions_of_responses(answered: DataFrame) -> DataFrame:
    """Answers back to mentions: ``(doc_id, task, category, pos, value)``, values
    parted at blanks, in upper case; empty answers give none."""
    parts = F.filter(F.split("answer", " "), lambda x: x != "")
    return answered.select("doc_id", "task", "category", F.posexplode(parts).alias("pos", "__v")).select("doc_id", "task", "category", "pos", F.upper("__v").alias("value"))
