"""Responses of a recogniser: codes per response, plain texts, no row lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
NO_RESPONSE, FAILED, OK = "10002", "10006", "200"
# ----------------------------------------------------------------------------------


def coded(responses: DataFrame) -> DataFrame:
    """Adds ``code``: no response, failed (message not success or an error), or ok.

    Errors stay rows of the same table."""
    bad = (F.coalesce("message", F.lit("")) != "success") | (F.coalesce("error", F.lit("")) != "")
    missing = F.col("error").isNull() & F.col("message").isNull()
    return responses.withColumn("code", F.when(missing, NO_RESPONSE).when(bad, FAILED).otherwise(OK))


def plain_text(boxes: DataFrame, key: list[str]) -> DataFrame:
    """``(key..., text)``: box texts in order, each with a newline."""
    parts = F.array_sort(F.collect_list(F.struct("box_index", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("t"))))
    return boxes.groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))


def error_report(coded_responses: DataFrame) -> DataFrame:
    """Responses that are not ok, by code."""
    return coded_responses.where(F.col("code") != OK).groupBy("code").agg(F.count("*").alias("responses"))
