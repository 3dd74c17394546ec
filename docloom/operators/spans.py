"""Question answering over overlapping chunks: windows, votes, n-best spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions import arrays


def chunks(df: DataFrame, id_column: str, length: str, room: int, stride: int) -> DataFrame:
    """``(id, chunk, start, size)``: overlapping windows over a sequence length."""
    starts = arrays.window_starts(F.col(length), room, stride)
    out = df.select(id_column, F.col(length).alias("__n"), F.posexplode(starts).alias("chunk", "start"))
    return out.select(id_column, "chunk", "start", F.least(F.lit(room), F.col("__n") - F.col("start")).alias("size"))


def max_context(chunked: DataFrame, id_column: str) -> DataFrame:
    """``(id, pos, chunk)``: for each position the chunk that shows most of its
    surroundings, ``min(left, right) + size / 100``; the first wins."""
    pos = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")
    p = chunked.where("size > 0").select(id_column, "chunk", "start", "size", pos)
    left, right = F.col("pos") - F.col("start"), F.col("start") + F.col("size") - 1 - F.col("pos")
    # in hundredths, so that it is exact
    score = F.least(left, right) * 100 + F.col("size")
    return p.groupBy(id_column, "pos").agg(F.max_by("chunk", F.struct(score, -F.col("chunk"))).alias("chunk"))


def candidates(scored: DataFrame, n: int = 10, longest: int = 200) -> DataFrame:
    """``(qas_id, chunk, s, e, score)``: pairs of the ``n`` best starts and ends of
    each chunk that lie in the document part, in order and not too long.

    ``scored`` has ``qas_id, chunk, start_logits, end_logits, first, last`` (bounds
    of the document part, inclusive)."""
    s = scored.select("*", F.explode(arrays.best_indexes(F.col("start_logits"), n)).alias("s"))
    e = s.select("*", F.explode(arrays.best_indexes(F.col("end_logits"), n)).alias("e"))
    ok = (F.col("s") >= F.col("first")) & (F.col("e") <= F.col("last")) & (F.col("e") >= F.col("s")) & (F.col("e") - F.col("s") + 1 <= longest)
    total = F.get("start_logits", F.col("s")) + F.get("end_logits", F.col("e"))
    return e.where(ok).select("qas_id", "chunk", "s", "e", total.alias("score"))


def n_best(spans: DataFrame, n: int = 10) -> DataFrame:
    """``(qas_id, text, score, rank)``: distinct texts by their best score; ties by
    chunk, start and end. ``spans`` has ``qas_id, chunk, s, e, score, text``."""
    order = [F.desc("score"), F.col("chunk"), F.col("s"), F.col("e")]
    once = Window.partitionBy("qas_id", "text").orderBy(*order)
    best = spans.withColumn("__r", F.row_number().over(once)).where("__r = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qas_id").orderBy(*order))).where(F.col("rank") <= n).drop("__r")


def n_best_json(best: DataFrame) -> DataFrame:
    """``(qas_id, nbest)``: the n best as a JSON list of text, probability (the softmax of
    their scores), score and place, in order of rank."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "text", "score", "s", "e")))
    p = F.transform(arrays.softmax(F.transform("__b", lambda b: b["score"])), lambda x: F.round(x, 6))
    rows = F.zip_with("__b", p, lambda b, x: F.struct(b["text"].alias("text"), x.alias("probability"), b["score"].alias("score"), b["s"].alias("start_index"), b["e"].alias("end_index")))
    return best.groupBy("qas_id").agg(listed.alias("__b")).select("qas_id", F.to_json(rows).alias("nbest"))


def vote(votes: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``(qas_id, n_chunks, n_none, answered)``: unanswered iff so many chunks say
    that there is no answer (with 1: all)."""
    n, none = F.count("*"), F.sum("no_answer")
    return votes.groupBy("qas_id").agg(n.alias("n_chunks"), none.alias("n_none"), (none < n / F.lit(threshold)).alias("answered"))


def widened(start: Column, end: Column, first: Column, last: Column, reach: int = 10) -> list[Column]:
    """A span widened by up to ``reach`` positions within the document part."""
    return [F.greatest(start - reach, first).alias("wide_start"), F.least(end + reach, last).alias("wide_end")]


def tightest(tokens: Column, answer: Column, start: Column, end: Column) -> Column:
    """The first shortest-from-the-left sub-span of ``[start, end]`` whose tokens
    equal ``answer``; the span itself if there is none."""
    none = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    def search(pair: Column) -> Column:
        t, w = pair["t"], pair["w"]
        n = F.size(w)
        at = F.filter(
            F.when(end - n + 1 >= start, F.sequence(start, end - n + 1)).otherwise(F.array().cast("array<int>")),
            # the first token is compared before a slice is taken
            lambda i: (F.get(t, i) == F.get(w, F.lit(0))) & (F.slice(t, i + 1, n) == w),
        )
        return arrays.let(at, lambda a: F.when((F.size(a) > 0) & (n > 0), F.struct(F.get(a, F.lit(0)).alias("start"), (F.get(a, F.lit(0)) + n - 1).alias("end"))).otherwise(none))

    return arrays.let(F.struct(tokens.alias("t"), answer.alias("w")), search)


def _align(pred: str, text: str, lower: bool) -> str:
    """``pred`` (tokens joined) as it stands in ``text``, matched without blanks."""
    bare = [(c, i) for i, c in enumerate(text) if not c.isspace()]
    flat = "".join(c for c, _ in bare)
    want = "".join(pred.split())
    if not want:
        return text
    at = (flat.lower() if lower and len(flat.lower()) == len(flat) else flat).find(want.lower() if lower else want)
    return text if at < 0 else text[bare[at][1] : bare[at + len(want) - 1][1] + 1]


def original_text(lower: bool = True):
    """A column function ``(predicted, original)``: the predicted text as written in
    the original; the original where it cannot be aligned."""

    @F.pandas_udf(T.StringType())
    def align(pred: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or t is None else _align(p, t, lower) for p, t in zip(pred, text)], dtype=object)

    return align


def joined_pieces(pieces: Column) -> Column:
    """Word pieces as one text without continuation marks and blanks."""
    return F.replace(F.replace(F.array_join(pieces, " "), F.lit(" ##"), F.lit("")), F.lit(" "), F.lit(""))


def questions(documents: DataFrame) -> DataFrame:
    """Nested question-answering documents flattened: ``(doc_id, qas_id, question,
    context, answer, answer_start)``; the answer stands where it first occurs in the
    context, unmatched ones are null."""
    p = documents.select(F.explode("data").alias("d")).select("d.id", F.explode("d.paragraphs").alias("p"))
    q = p.select(F.col("id").alias("doc_id"), F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    a = F.get("q.answers.text", F.lit(0))
    at = F.instr("context", a) - 1
    return q.select("doc_id", F.col("q.id").alias("qas_id"), F.col("q.question").alias("question"), "context", a.alias("answer"),
                    F.when(a == "", F.lit(0)).when(at >= 0, at).alias("answer_start"))
