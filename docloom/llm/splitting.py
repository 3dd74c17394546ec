"""Problem 1: splitting oversized items at natural boundaries.

Recursive separator hierarchy: section (blank line), paragraph (line break),
sentence, clause, word; a single word that alone exceeds the limit of a
character-sized split is cut between characters. Parts are packed greedily up to the
limit; a part that no piece can hold, or that would leave a piece nearly empty, is
split at its own next weaker separators. Pieces repeat the last ``overlap`` units of
the piece before and add at least a quarter of the limit (but for the last).

Defined results: null items give no piece; an item within the limit (an empty
one too) is one piece; blank words (null, empty, spaces) count for nothing and
travel with the piece they stand in; labels, if given, are cut alike.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.textform import LINE_BREAK

SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "of")]))
#: A word of nothing but white space, as ``str.strip`` sees it.
BLANK = r"^[\s\p{Z}\u001c-\u001f\u0085]*$"
SENTENCE_END = frozenset("。！？!?；;．…")
CLAUSE_END = frozenset("，,、：:）)")


def strength(unit: str, following: str | None) -> int:
    """How natural a cut after ``unit`` is: 4 section, 3 paragraph, 2 sentence, 1 clause, 0 word."""
    if unit in (LINE_BREAK, "\n"):
        return 4 if following in (LINE_BREAK, "\n") else 3
    last = unit[-1]
    if last in SENTENCE_END:
        return 2
    if last == "." and (following is None or not following[:1].isalnum()):
        return 2
    return 1 if last in CLAUSE_END else 0


def packed(ends: list[int], power: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces ``[start, end)`` of at most ``limit`` over units that end at ``ends``, with
    the strength of a cut after each unit."""
    pieces: list[tuple[int, int]] = []
    start, done, least = 0, 0, max(1, limit // 4)  # of the open piece; end of the last one
    held = 0  # end of what the open piece holds
    parts = [(0, len(ends), 4)]  # units [from, to) and the separators they are split at
    while parts:
        a, b, level = parts.pop()
        if ends[b - 1] - start <= limit:
            held = ends[b - 1]
            continue
        first = ends[a - 1] if a else 0
        full = held - done >= least and held - start > overlap
        if full and (ends[b - 1] - first <= limit - overlap or level == 0):
            pieces.append((start, held))
            start, done = held - overlap, held
            parts.append((a, b, level))
        elif level:
            cuts = [a, *(i + 1 for i in range(a, b - 1) if power[i] >= level), b]
            parts.extend((x, y, level - 1) for x, y in zip(reversed(cuts[:-1]), reversed(cuts[1:])))
        else:  # between words, as far as the piece goes
            k = max(bisect.bisect_right(ends, start + limit, a, b), a)
            held = ends[k - 1] if k and ends[k - 1] > max(done, start + overlap) else start + limit
            pieces.append((start, held))
            start, done = held - overlap, held
            parts.append((k, b, 0))
    if held > done or not pieces:
        pieces.append((start, ends[-1] if ends else 0))
    return pieces


def cut(units: list[str], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces ``[start, end)`` over ``units``, each of at most ``limit``."""
    n = len(units)
    if n <= limit:
        return [(0, n)]
    return packed(list(range(1, n + 1)), [strength(u, units[i + 1] if i + 1 < n else None) for i, u in enumerate(units)], limit, overlap)


def word_spans(words, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans over all elements of ``words``; only non-blank words count."""
    solid = [i for i, w in enumerate(words) if w and w.strip()]
    if len(solid) <= limit:
        return [(0, len(words))]
    spans = cut([words[i] for i in solid], limit, overlap)
    last = len(spans) - 1
    return [(0 if k == 0 else solid[a], len(words) if k == last else solid[b - 1] + 1) for k, (a, b) in enumerate(spans)]


def split_words(df: DataFrame, id_column: str, words: str = "words", limit: int = 254, overlap: int = 32, labels: str | None = None) -> DataFrame:
    """One row per piece: id, ``piece``, ``n_pieces``, ``start_word``, ``end_word``, ``piece_words`` (and ``piece_labels``).

    Only the words of items over the limit are sent to Python, once; their spans
    come back and the slices are taken in the JVM."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")

    @F.pandas_udf(SPAN)
    def spans(batch: pd.Series) -> pd.Series:
        def one(words):
            if words is None:
                return None
            found = word_spans(words, limit, overlap)
            return [{"start": a, "end": b, "of": len(found)} for a, b in found]

        return batch.map(one)

    w = F.col("__w")
    solid = F.size(F.filter(w, lambda x: ~F.coalesce(x, F.lit("")).rlike(BLANK)))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size(w).alias("end"), F.lit(1).alias("of")))
    keep = [F.col(id_column).alias("__id"), F.col(words).alias("__w")] + ([F.col(labels).alias("__l")] if labels else [])
    out = df.select(*keep).where(w.isNotNull())
    # other items are nulls for the function
    out = out.select("*", F.posexplode(F.coalesce(spans(F.when(solid > limit, w)), whole)).alias("piece", "__s")).withColumn("__n", F.col("__s.end") - F.col("__s.start"))
    cols = [
        F.col("__id").alias(id_column), "piece", F.col("__s.of").alias("n_pieces"), F.col("__s.start").alias("start_word"),
        F.col("__s.end").alias("end_word"), F.slice(w, F.col("__s.start") + 1, F.col("__n")).alias("piece_words"),
    ]
    if labels:
        cols.append(F.slice("__l", F.col("__s.start") + 1, F.col("__n")).alias("piece_labels"))
    return out.select(*cols)


_units = re.compile(r"\n|[ \t]*[A-Za-zÀ-ɏ0-9]+[ \t]*|[^\n]")


def text_units(text: str, limit: int) -> list[str]:
    """Units of a free text: line breaks, words, single other characters;
    words longer than ``limit`` characters are broken into characters."""
    units = []
    for u in _units.findall(text):
        units.extend(u if len(u) > limit else [u])
    return units


def text_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Character spans of at most ``limit`` characters over ``text``."""
    if len(text) <= limit:
        return [(0, len(text))]
    units = text_units(text, limit)
    ends, at = [], 0
    for u in units:
        at += len(u)
        ends.append(at)
    power = [strength(u.rstrip(" \t") or u, units[i + 1] if i + 1 < len(units) else None) for i, u in enumerate(units)]
    return packed(ends, power, limit, overlap)


def split_text(df: DataFrame, id_column: str, text: str = "text", limit: int = 2000, overlap: int = 100) -> DataFrame:
    """One row per piece of a free text: id, ``piece``, ``n_pieces``, ``start_char``, ``piece_text``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")

    kind = T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("piece_text", T.StringType()), T.StructField("of", T.IntegerType())]))

    @F.pandas_udf(kind)
    def pieces(batch: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            found = text_spans(t, limit, overlap)
            return [{"start_char": a, "piece_text": t[a:b], "of": len(found)} for a, b in found]

        return batch.map(one)

    t = F.col("__t")
    whole = F.array(F.struct(F.lit(0).alias("start_char"), t.alias("piece_text"), F.lit(1).alias("of")))
    out = df.select(F.col(id_column).alias("__id"), F.col(text).alias("__t")).where(t.isNotNull())
    out = out.select("__id", F.posexplode(F.coalesce(pieces(F.when(F.length(t) > limit, t)), whole)).alias("piece", "__s"))
    return out.select(F.col("__id").alias(id_column), "piece", F.col("__s.of").alias("n_pieces"), "__s.start_char", "__s.piece_text")
