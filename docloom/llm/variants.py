"""Problem 6: visually identical text made of different characters.

``normalize_text`` / ``normalize_words`` bring a column to the one consistent
form, ``find_variants`` reports the rows that were not in it.

Only rows with at least one suspect code point reach Python (a JVM regex sorts
them out), so clean text costs a scan. Defined results: null stays null, empty
stays empty, every other column of the input is kept as it is; very long texts
are processed whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import textform


@F.pandas_udf(T.StringType())
def _canon(s: pd.Series) -> pd.Series:
    return s.map(textform.canon, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def _has_variant(s: pd.Series) -> pd.Series:
    return s.map(textform.has_variant, na_action="ignore")


def joined_words(words: Column) -> Column:
    """``words`` strung together; line-break words become newlines, nulls vanish."""
    return F.replace(F.array_join(words, ""), F.lit(textform.LINE_BREAK), F.lit("\n"))


def canon_column(text: Column) -> Column:
    """The one consistent form of a string column."""
    # a function under ``when`` sees every row: the clean ones are nulls for it
    return F.coalesce(_canon(F.when(text.rlike(textform.SUSPECT), text)), text)


def normalize_text(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """``df`` with ``column`` (or a new column ``out``) in the one form."""
    return df.withColumn(out or column, canon_column(F.col(column)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _canon_words(batches: pd.Series) -> pd.Series:
    def one(words):
        if words is None:
            return None
        out = []
        text, at = textform.canon_aligned(list(words))
        cells = [None if w is None else [] for w in words]
        for c, i in zip(text, at):
            cells[i].append(textform.LINE_BREAK if words[i] == textform.LINE_BREAK else c)
        for w in cells:
            out.append(None if w is None else "".join(w))
        return out

    return batches.map(one)


def normalize_words(df: DataFrame, column: str = "words", out: str | None = None) -> DataFrame:
    """As :func:`normalize_text` for an array of words; look-alike letters are
    judged over tokens that span words, the number of words is unchanged."""
    words = F.col(column)
    return df.withColumn(out or column, F.coalesce(_canon_words(F.when(joined_words(words).rlike(textform.SUSPECT), words)), words))


def find_variants(df: DataFrame, id_column: str, text: Column, src: str) -> DataFrame:
    """``(src, row_id)`` of rows whose text holds a variant form; distinct ids."""
    suspects = df.select(F.col(id_column).cast("bigint").alias("row_id"), text.alias("__text")).where(F.col("__text").rlike(textform.SUSPECT))
    return suspects.where(_has_variant("__text")).select(F.lit(src).alias("src"), "row_id").distinct()
