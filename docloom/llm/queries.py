"""The queries of the training-data problems over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import leakage, mapping, overlap, packing, privacy, spam, splitting, variants
from docloom.session import read, spread

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples that come out as more than one piece."""
    pieces = splitting.split_words(read(spark, sf_dir, "examples").select("example_id", "words"), "example_id")
    return pieces.where("n_pieces > 1").select("example_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every example, words and labels cut alike."""
    return splitting.split_words(read(spark, sf_dir, "examples"), "example_id", labels="labels")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and a dev or test example of (nearly) equal text."""
    pairs = overlap.overlaps(read(spark, sf_dir, "examples"))
    a, b = F.col("example_train"), F.col("example_eval")
    return pairs.select(F.least(a, b).alias("example_a"), F.greatest(a, b).alias("example_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and pair of sources."""
    pairs = overlap.overlaps(read(spark, sf_dir, "examples"))
    return pairs.groupBy("split", "source_eval", "source_train").agg(
        F.count("*").alias("pairs"), F.count_distinct("example_eval").alias("evaluation_examples"),
        F.sum(F.when(F.col("distance") == 0, 1).otherwise(0)).alias("equal_pairs"),
    )


_pii_mentions = "category in ('Name', 'Admission_Number') and value is not null"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "gazetteer").where("list_name = 'place_py'")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First position of every personal item in examples and mentions."""
    examples = spread(read(spark, sf_dir, "examples").select("example_id", "words").where("words is not null"))
    mentions = read(spark, sf_dir, "mentions").where(_pii_mentions).select("mention_id", "value", "category")
    in_words = privacy.find_in_words(examples, "example_id", places=_places(spark, sf_dir)).withColumn("src", F.lit("examples"))
    in_values = privacy.find_in_values(mentions, "mention_id", "value", F.col("category") == "Name").withColumn("src", F.lit("mentions"))
    return in_words.unionByName(in_values).select("src", "row_id", "kind", F.col("start").alias("start_pos")).distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with a placeholder for each item."""
    examples = spread(read(spark, sf_dir, "examples").select("example_id", "words").where("words is not null"))
    mentions = read(spark, sf_dir, "mentions").where(_pii_mentions).select("mention_id", "value", "category")
    words = privacy.redact_words(examples, places=_places(spark, sf_dir)).select(F.lit("examples").alias("src"), F.col("example_id").alias("row_id"), F.array_join("words", " ").alias("redacted"))
    values = privacy.redact_values(mentions, "value", F.col("category") == "Name")
    return words.unionByName(values.select(F.lit("mentions").alias("src"), F.col("mention_id").alias("row_id"), F.col("value").alias("redacted")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that are not letter for letter an entry of their list, mapped."""
    gazetteer = read(spark, sf_dir, "gazetteer")
    mapped = mapping.map_mentions(read(spark, sf_dir, "mentions"), gazetteer)
    return mapped.join(gazetteer.select("list_name", "value"), ["list_name", "value"], "left_anti").select("mention_id", "list_pos").distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no entry, with their number of mentions."""
    mapped = mapping.map_mentions(read(spark, sf_dir, "mentions"), read(spark, sf_dir, "gazetteer"))
    return mapped.where("list_pos = -1").groupBy("list_name", "value").agg(F.count("*").alias("mentions"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = read(spark, sf_dir, "examples").where("words is not null")
    mentions = read(spark, sf_dir, "mentions").where("category = 'Department'")
    return variants.find_variants(examples, "example_id", variants.joined_words(F.col("words")), "examples").unionByName(
        variants.find_variants(mentions, "mention_id", F.col("value"), "mentions")
    )


def p6_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Department values in the one form with the number of mentions and spellings of each."""
    mentions = read(spark, sf_dir, "mentions").where("category = 'Department' and value is not null").select("value")
    per_spelling = mentions.groupBy("value").count()
    return (
        variants.normalize_text(per_spelling, "value", "department")
        .groupBy("department")
        .agg(F.sum("count").alias("mentions"), F.count("*").alias("spellings"))
    )


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin and slot of every piece of every document."""
    return packing.pack(packing.count_tokens(read(spark, sf_dir, "documents")))


def p7_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins, tokens and the room left over, in all."""
    bins = p7_packed(spark, sf_dir).where("bin_id is not null").groupBy("bin_id").agg(F.sum("n_tokens").alias("tokens"))
    return bins.agg(
        F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        (1 - F.sum("tokens") / (F.count("*") * 2048)).alias("room_left"),
    )


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed training sequences."""
    documents = read(spark, sf_dir, "documents")
    return packing.packed_sequences(documents, packing.pack(packing.count_tokens(documents)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they give away."""
    return leakage.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that give them away."""
    leaks = leakage.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))
    items = read(spark, sf_dir, "eval_items").select("item_id", "split", "task")
    return leaks.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("share").alias("largest_share")).join(items, "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which three quarters are keywords, links or tags."""
    return spam.find_stuffed(read(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stuffed pages per source."""
    documents = read(spark, sf_dir, "documents")
    found = spam.find_stuffed(documents)
    return documents.select("doc_id", "source").join(found, "doc_id").groupBy("source").agg(F.count("*").alias("pages"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
