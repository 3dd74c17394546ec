"""Struct types and the small dimension tables of the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BOX = T.StructType([
    T.StructField("coord", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
RESPONSE = T.StructType([
    T.StructField("error", T.StringType()),
    T.StructField("result", T.StructType([T.StructField("message", T.StringType()), T.StructField("info", T.ArrayType(BOX))])),
])
TOKEN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("label", T.StringType())])
QA = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("paragraphs", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("context", T.StringType()),
        T.StructField("qas", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()), T.StructField("question", T.StringType()),
            T.StructField("answers", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("answer_start", T.IntegerType())]))),
        ]))),
    ]))),
])))])
SCORES = T.StructType([
    T.StructField("unique_id", T.LongType()), T.StructField("start_logits", T.ArrayType(T.DoubleType())),
    T.StructField("end_logits", T.ArrayType(T.DoubleType())), T.StructField("no_answer", T.IntegerType()),
])

# --- fixed values: the word that stands for a line break ---------------------
LINE_BREAK = "mjwemptymjw"

#: Categories of each task, in the order in which results list them.
TASK_CATEGORIES = {
    "boardcards": ("Name", "Name_PY", "Origin", "Origin_PY", "Destination", "Destination_PY", "Flight_Number", "Flight_Date"),
    "xingchengdan": ("Name", "Flight_Number", "Flight_Date", "Origin", "Destination", "Ticket_Fee", "Total_Fee"),
    "discharge_records": ("Name", "sex", "age", "Hospital_Name", "Department", "bed_number", "Admission_Number", "Admission_Date", "Discharge_Date", "ad_diag", "dis_diag"),
    "imaging_report": ("Name", "Hospital_Name", "Check_Part", "Check_Date", "Report_Date", "Conclusion"),
}


def task_categories(spark: SparkSession) -> DataFrame:
    """Dimension ``(task, cat_pos, category)``; one row per task and category."""
    rows = [(t, i, c) for t, cs in TASK_CATEGORIES.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "task string, cat_pos int, category string")


def task_categories_sql() -> str:
    """The same dimension as an SQL ``VALUES`` list."""
    return ", ".join(f"('{t}', {i}, '{c}')" for t, cs in TASK_CATEGORIES.items() for i, c in enumerate(cs))
