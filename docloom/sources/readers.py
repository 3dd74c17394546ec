"""Readers: each comes as a reader of files and as a parser of a text column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import schemas


def tagged_lines(df: DataFrame, key: str, text: str = "text", keep_tail: bool = True, keep_empty: bool = False, separators: str = "blank") -> DataFrame:
    """Token-per-line text to ``(key, doc_no, pos, token, label)``.

    Documents are parted by blank lines (``separators='blank'`` also takes
    ``-DOCSTART-`` lines and lines of spaces; ``'exact'`` only the empty line).
    The token is the first field, the label the last, ``O`` if there is one field.
    ``keep_tail`` keeps a last document without a separator after it (one reader of
    the original keeps it, another drops it); ``keep_empty`` counts documents
    between consecutive separators, so that positions of parallel files agree."""
    lines = F.split(F.col(text), "\n", -1)
    n = F.size(lines)
    is_sep = (lambda x: F.trim(x).startswith("-DOCSTART-") | (F.trim(x) == "")) if separators == "blank" else (lambda x: x == "")
    # a text that ends in a newline has an empty string after it, which is no line
    real = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, n - 1)).otherwise(lines)
    rows = df.select(F.col(key), real.alias("__lines"))
    marks = F.transform("__lines", lambda x: is_sep(x).cast("int"))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    # number of separators before each line
    number = F.aggregate(marks, zero, lambda a, m: F.struct((a["n"] + m).alias("n"), F.concat(a["out"], F.array(a["n"])).alias("out")), lambda a: a["out"])
    z = rows.select(key, F.size("__lines").alias("__n"), F.aggregate(marks, F.lit(0), lambda a, m: a + m).alias("__seps"),
                    F.explode(F.arrays_zip(F.col("__lines").alias("line"), marks.alias("sep"), number.alias("run"), F.sequence(F.lit(0), F.size("__lines") - 1).alias("at"))).alias("z"))
    t = z.where("z.sep = 0")
    if not keep_tail:
        t = t.where("z.run < __seps")
    from pyspark.sql.window import Window

    w = Window.partitionBy(key)
    doc = F.col("z.run") if keep_empty else F.dense_rank().over(w.orderBy("z.run")) - 1
    pos = F.row_number().over(Window.partitionBy(key, "z.run").orderBy("z.at")) - 1
    field = F.split(F.rtrim("z.line"), " ")
    return t.select(key, doc.alias("doc_no"), pos.alias("pos"), F.element_at(field, 1).alias("token"),
                    F.when(F.size(field) > 1, F.element_at(field, -1)).otherwise(F.lit("O")).alias("label"))


def read_tagged(spark: SparkSession, path: str, **options) -> DataFrame:
    """Token-per-line files; the key is the file name."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return tagged_lines(df, "file", "text", **options)


def read_one_per_file(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, ``token tag`` lines, blank lines ignored: ``(file, tokens, labels)``."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    fields = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), r"\s+"))
    return df.select("file", F.transform(fields, lambda f: F.element_at(f, 1)).alias("tokens"), F.transform(fields, lambda f: F.try_element_at(f, F.lit(2))).alias("labels"))


def read_pairs(spark: SparkSession, path: str, with_source: bool = False) -> DataFrame:
    """Tab-separated ``[source,] sentence, label`` without header; one blank at
    either end is stripped."""
    names = (["source"] if with_source else []) + ["sentence", "label"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, sep="\t", schema=schema, quote="")
    return df.select(*[F.regexp_replace(n, "^ | $", "").alias(n) if n != "source" else F.col(n) for n in names])


def read_id_texts(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``path, spaced text``: ``(id, text)``, the id from the file
    name without its suffix, the text without blanks."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])
    df = spark.read.csv(path, sep="\t", schema=schema, quote="")
    return df.select(F.regexp_extract("path", r"([0-9a-z]+)\.txt\.ann", 1).alias("id"), F.replace("text", F.lit(" "), F.lit("")).alias("text"))


def labels_of(text: Column, with_outside: bool = True) -> Column:
    """Labels of a list text in order, ``O`` put first if it is missing."""
    found = F.filter(F.split(text, "\n"), lambda x: x != "")
    if not with_outside:
        return found
    return F.when(F.array_contains(found, "O"), found).otherwise(F.concat(F.array(F.lit("O")), found))


def read_key_values(df: DataFrame, key: str, text: str = "text", split_on_comma: tuple[str, ...] = ("Flight_Number",)) -> DataFrame:
    """``key:value`` lines to ``(key, category, value)``: blanks removed, upper case,
    listed categories split at commas."""
    lines = F.explode(F.split(F.regexp_replace(F.col(text), "[ \\r]", ""), "\n")).alias("line")
    kv = df.select(F.col(key), lines).where(F.instr("line", ":") > 0)
    category = F.expr("substring(line, 1, instr(line, ':') - 1)")
    value = F.upper(F.expr("substring(line, instr(line, ':') + 1)"))
    parts = F.when(category.isin(*split_on_comma), F.split(value, ",")).otherwise(F.array(value))
    return kv.select(key, category.alias("category"), F.explode(parts).alias("value")).where("value <> ''")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Service-log lines ``date - level - logger - message``."""
    p = r"^(\S+ \S+) - (\w+) - (\S+) - (.*)$"
    names = ("logged_at", "level", "logger", "message")
    return spark.read.text(path).where(F.col("value").rlike(p)).select(*[F.regexp_extract("value", p, i + 1).alias(n) for i, n in enumerate(names)])


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """A folder tree of response files: ``(file, payload)``."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return df.select(F.input_file_name().alias("file"), F.col("value").alias("payload"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Nested question-answering files, one object per file."""
    return spark.read.json(path, schema=schemas.QA, multiLine=True)


def table_values(df: DataFrame, amounts: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """A labelled sheet staged as a table: nulls to empty text, amounts with one
    decimal (half to even, as formatted by the original), dates ISO, full-width
    punctuation plain, blanks removed, upper case."""
    out = {}
    for c in df.columns:
        v = F.col(c)
        if c in amounts:
            v = F.bround(v.cast("decimal(20,6)"), 1).cast("string")
            v = F.regexp_replace(v, r"(\.\d)\d*$", "$1")
        elif c in dates:
            v = F.date_format(v, "yyyy-MM-dd")
        v = F.translate(F.coalesce(v.cast("string"), F.lit("")), "，：（） ", ",:()")
        out[c] = F.upper(v)
    return df.select(*[e.alias(c) for c, e in out.items()])


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A folder tree of files of any kind, images say: ``(file, name, length, content)``;
    ``content`` is only read where it is selected."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select(F.col("path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def read_run_codes(spark: SparkSession, path: str, log: str = "log.json") -> DataFrame:
    """``(folder, code)`` of every folder with files below ``path``: the code of the first
    entry of its log; null where there is no log or none can be read."""
    files = read_files(spark, path).select(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder"), "name")
    folders = files.groupBy("folder").agg(F.max(F.col("name") == log).alias("__has"))
    logs = read_files(spark, path, log).select(
        F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder"), F.get_json_object(F.col("content").cast("string"), "$[0].code").alias("code")
    )
    return folders.join(logs, "folder", "left").select("folder", F.when(F.col("__has"), F.col("code")).alias("code"))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 (with or without its mark) if they are that, UTF-16 with a mark,
    else the Chinese national encoding with what it lacks replaced."""

    def one(data) -> str:
        data = bytes(data)
        if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return data.decode("utf-16", "replace")
        try:
            return data.decode("utf-8-sig")
        except UnicodeDecodeError:
            return data.decode("gb18030", "replace")

    return content.map(one, na_action="ignore")


def read_sheets(spark: SparkSession, path: str, invalid: DataFrame | None = None, suffix: str = ".correct") -> DataFrame:
    """``key:value`` files of any encoding: ``(id, category, value)``, the id from the file name
    without its suffix; ids of ``invalid`` are left out. Only flight numbers are lists."""
    files = read_files(spark, path, f"*{suffix}")
    sheets = files.select(F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias("id"), decoded("content").alias("text"))
    if invalid is not None:
        sheets = sheets.join(invalid.select("id").distinct(), "id", "left_anti")
    return read_key_values(sheets, "id", split_on_comma=("Flight_Number", "航班号"))
