"""Tag sequences to mentions: islands over one ordered window per document.

Input is the long form ``(doc_id, pos, token, label)``. The running counts use
windows that share the document as partition key, so decoding and the grouping
that follows need one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_tokens(df: DataFrame, id_column: str, words: str = "words", labels: str = "labels") -> DataFrame:
    """Parallel arrays to the long form; a missing label array gives no rows."""
    z = F.arrays_zip(F.col(words).alias("token"), F.col(labels).alias("label"))
    out = df.where(F.col(words).isNotNull() & F.col(labels).isNotNull()).select(F.col(id_column).alias("doc_id"), F.posexplode(z).alias("pos", "__z"))
    return out.select("doc_id", "pos", "__z.token", "__z.label")


def _text(pos: Column, token: Column, sep: str = "") -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(pos.alias("p"), F.coalesce(token, F.lit("")).alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), sep)


def decode(tokens: DataFrame, glue: str | None = None) -> DataFrame:
    """Untyped decoding: ``(doc_id, ent, category, start_pos, n_tokens, value)``.

    ``B-`` starts a mention of its type, ``I-`` of any type continues while a
    mention is open, anything else closes it; a stray ``I-`` is dropped. For the
    category ``glue``, a ``B-`` right after an original ``I-`` of that category
    continues the mention (not cascading)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    label = F.coalesce(F.col("label"), F.lit("O"))
    begins = label.startswith("B-")
    if glue:
        begins = begins & ~((label == f"B-{glue}") & (F.coalesce(F.lag("label").over(w), F.lit("")) == f"I-{glue}"))
    inside = begins | label.startswith("I-") | label.startswith("B-")
    t = tokens.select("doc_id", "pos", "token", label.alias("label"), begins.alias("__b"), inside.alias("__in"))
    t = t.withColumn("ent", F.sum(F.col("__b").cast("int")).over(w))
    e = Window.partitionBy("doc_id", "ent").orderBy("pos")
    t = t.withColumn("__closed", F.sum((~F.col("__in")).cast("int")).over(e)).where("ent > 0 and __closed = 0")
    return t.groupBy("doc_id", "ent").agg(
        F.min_by(F.substring("label", 3, 1000), "pos").alias("category"), F.min("pos").alias("start_pos"),
        F.count("*").alias("n_tokens"), _text(F.col("pos"), F.col("token")).alias("value"),
    )


def decode_typed(tokens: DataFrame) -> DataFrame:
    """Typed decoding with offsets: ``(doc_id, category, start, end, value)``.

    Adjacent ``B-B`` splits, a stray ``I-`` is skipped, a tag of another type
    closes. ``end`` is exclusive, in tokens."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    label = F.coalesce(F.col("label"), F.lit("O"))
    kind = F.when(label.rlike("^[BI]-"), F.substring(label, 3, 1000))
    prev = F.lag("__kind").over(w)
    t = tokens.select("doc_id", "pos", "token", label.alias("label"), kind.alias("__kind"))
    # a new island at every B and at every change of type
    t = t.withColumn("__new", (F.col("label").startswith("B-") | ~F.col("__kind").eqNullSafe(prev)).cast("int"))
    t = t.withColumn("__isle", F.sum("__new").over(w)).where(F.col("__kind").isNotNull())
    g = t.groupBy("doc_id", "__isle").agg(
        F.first("__kind").alias("category"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"),
        F.min_by("label", "pos").alias("__first"), _text(F.col("pos"), F.col("token")).alias("value"),
    )
    return g.where(F.col("__first").startswith("B-")).select("doc_id", "category", "start", "end", "value")


def decode_ids(tokens: DataFrame, keep_last: bool = False) -> DataFrame:
    """Decoding of id tags (2 begins, 3 continues): ``(doc_id, island, start_pos, value)``.

    Adjacent beginnings merge into one mention. The original procedure never
    flushes the last open mention of a document; ``keep_last`` repairs that."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    inside = F.col("tag").isin(2, 3)
    t = tokens.withColumn("__in", inside.cast("int"))
    t = t.withColumn("__new", ((F.col("tag") == 2) & (F.coalesce(F.lag("__in").over(w), F.lit(0)) == 0)).cast("int"))
    t = t.withColumn("island", F.sum("__new").over(w))
    i = Window.partitionBy("doc_id", "island").orderBy("pos")
    t = t.withColumn("__closed", F.sum(1 - F.col("__in")).over(i)).where("island > 0 and __closed = 0")
    g = t.groupBy("doc_id", "island").agg(F.min("pos").alias("start_pos"), _text(F.col("pos"), F.col("token")).alias("value"))
    if keep_last:
        return g
    return g.withColumn("__last", F.max("island").over(Window.partitionBy("doc_id"))).where("island < __last").drop("__last")


def token_accuracy(pairs: DataFrame, pad: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, n_equal, accuracy)`` of ``(doc_id, pos, gold, pred)``;
    positions whose gold label is ``pad`` are left out."""
    p = pairs if pad is None else pairs.where(~F.col("gold").eqNullSafe(pad))
    n, ok = F.count("*"), F.sum(F.col("gold").eqNullSafe(F.col("pred")).cast("bigint"))
    return p.groupBy("doc_id").agg(n.alias("n_tokens"), ok.alias("n_equal"), (ok / n).alias("accuracy"))


def entity_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Exact span and type match: ``(category, gold, pred, correct)`` from two
    outputs of :func:`decode_typed`."""
    keys = ["doc_id", "category", "start", "end"]
    g, p = gold.select(*keys).withColumn("g", F.lit(1)), pred.select(*keys).withColumn("p", F.lit(1))
    both = g.join(p, keys, "full_outer")
    return both.groupBy("category").agg(
        F.count("g").alias("gold"), F.count("p").alias("pred"), F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("correct")
    )
