"""Writers and the text forms they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tagged_text(tokens: DataFrame) -> DataFrame:
    """``(doc_id, text)``: ``token label`` lines with a blank line at the end."""
    line = F.concat_ws(" ", F.coalesce("token", F.lit("")), F.coalesce("label", F.lit("O")))
    parts = F.array_sort(F.collect_list(F.struct("pos", line.alias("t"))))
    return tokens.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(parts, lambda x: x["t"]), "\n"), F.lit("\n\n")).alias("text"))


def predicted(texts: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(doc_id, pos, token, label)``: token lines with their predicted label; tokens
    beyond a truncated prediction are left out.

    ``texts`` has ``doc_id`` and ``words``, ``predictions`` ``doc_id`` and ``labels``, one row
    a document. The rows meet by a merge join before they are unfolded: a plan takes
    unfolded arrays for no larger than the file, and would send all tokens to the driver.
    Arrays travel as ``VARIANT``, which takes half of their bytes in the shuffle."""
    sides = [df.select("doc_id", F.to_variant_object(c).alias(c)).hint("merge") for df, c in ((texts, "words"), (predictions, "labels"))]
    words, labels = (F.col(c).cast("array<string>") for c in ("words", "labels"))
    both = sides[0].join(sides[1], "doc_id").select("doc_id", words.alias("words"), labels.alias("labels"))
    lines = F.arrays_zip(F.col("words").alias("token"), F.col("labels").alias("label"))
    lines = F.slice(lines, F.lit(1), F.least(F.size("words"), F.size("labels")))
    return both.select("doc_id", F.posexplode(lines).alias("pos", "__z")).select("doc_id", "pos", "__z.token", "__z.label")


def pair_line(tokens: Column, labels: Column) -> Column:
    """Tokens, a tab and labels, blank-separated also around the tab."""
    return F.concat_ws(" ", F.array_join(tokens, " "), F.lit("\t"), F.array_join(labels, " "))


def key_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key = value`` lines in order of the key."""
    return df.orderBy(key).select(F.concat_ws(" = ", F.col(key), F.col(value).cast("string")).alias("value"))


def score_lines(report: DataFrame) -> DataFrame:
    """Scores with three decimals, ready for a CSV."""
    three = [F.format_string("%.3f", F.col(c)).alias(c) for c in ("precision", "recall", "f1")]
    return report.select("category", "pred", "gold", "correct", *three)


def set_lines(values: DataFrame, number: str = "doc_id") -> DataFrame:
    """``(category, value)``: lines ``number+1 category:values``, the values sorted, one a
    document and category, for a dump of each category."""
    line = F.concat((F.col(number) + 1).cast("string"), F.lit(" "), F.col("category"), F.lit(":"), F.array_join(F.sort_array("values"), ","))
    return values.select("category", number, line.alias("value"))


def write_by(lines: DataFrame, path: str, column: str = "category") -> None:
    """A folder of text for each value of ``column``."""
    lines.select(column, "value").write.mode("overwrite").partitionBy(column).text(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", drop: str = "") -> None:
    """CSV with header; characters that the encoding lacks can be dropped."""
    out = df.select(*[F.translate(F.col(c).cast("string"), drop, "").alias(c) if drop else F.col(c) for c in df.columns])
    out.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_features(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """A feature cache: written once, read afterwards."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if overwrite or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
