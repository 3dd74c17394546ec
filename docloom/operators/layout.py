"""Boxes to reading-order text: rows, order within rows, gaps, paragraphs.

Input is one row per box: ``doc_id, box_idx, text`` and the corners
``ax ay bx by cx cy dx dy`` (top left, top right, bottom right, bottom left).
All windows share the document as partition key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.normalize import is_amount_text, without_letters
from docloom.functions.text import shared_characters


def _doc():
    return Window.partitionBy("doc_id")


def _input():
    """Boxes of a document in input order."""
    return _doc().orderBy("box_idx")


def geometry(boxes: DataFrame) -> DataFrame:
    """Adds ``min_y, avg_y, x_start, x_end, x_center, height``."""
    c = F.col
    return boxes.withColumns({
        "min_y": F.least("ay", "by", "cy", "dy"), "avg_y": (c("ay") + c("by") + c("cy") + c("dy")) / 4,
        "x_start": (c("ax") + c("dx")) / 2, "x_end": (c("bx") + c("cx")) / 2,
        "x_center": (c("ax") + c("bx") + c("cx") + c("dx")) / 4, "height": ((c("cy") - c("by")) + (c("dy") - c("ay"))) / 2,
    })


def corners(points: DataFrame) -> DataFrame:
    """Flat points ``(doc_id, box_idx, point_index, x, y)`` to one row of corners per box."""
    names = {0: "a", 1: "b", 2: "c", 3: "d"}
    aggs = [F.max(F.when(F.col("point_index") == i, F.col(k))).alias(f"{n}{k}") for i, n in names.items() for k in ("x", "y")]
    return points.groupBy("doc_id", "box_idx").agg(*aggs)


def rows_by_previous(geo: DataFrame) -> DataFrame:
    """Adds ``row_id``: a box begins a row iff its top is not above the middle of
    the box before it in input order."""
    prev = F.lag("avg_y").over(_input())
    return geo.withColumn("row_id", F.sum((F.coalesce(F.col("min_y") >= prev, F.lit(False))).cast("int")).over(_input()))


def rows_by_font(geo: DataFrame) -> DataFrame:
    """Adds ``row_id``: a box begins a row iff its middle lies a font size or more
    below the middle of the box before; the font size is the mean height of the
    three boxes around (of the last box: of the ones around its predecessor)."""
    font = F.avg("height").over(_input().rowsBetween(-1, 1))
    g = geo.withColumn("__font", font)
    last = F.lead("box_idx").over(_input()).isNull()
    g = g.withColumn("__font", F.when(last, F.coalesce(F.lag("__font").over(_input()), F.col("__font"))).otherwise(F.col("__font")))
    begins = F.coalesce(F.col("avg_y") >= F.lag("avg_y").over(_input()) + F.col("__font"), F.lit(False))
    return g.withColumn("row_id", F.sum(begins.cast("int")).over(_input())).drop("__font")


def font_size(geo: DataFrame, *keys: str) -> DataFrame:
    """Mean box height per group."""
    return geo.groupBy(*keys).agg(F.avg("height").alias("font_size"))


def ordered(rows: DataFrame) -> DataFrame:
    """Adds ``row_pos``: boxes of a row from left to right, ties in input order."""
    w = Window.partitionBy("doc_id", "row_id").orderBy("x_center", "box_idx")
    return rows.withColumn("row_pos", F.row_number().over(w) - 1)


def gaps(order: DataFrame) -> DataFrame:
    """Adds ``n_blanks`` after each box: twice ``int(gap / font + 2)``, never negative."""
    w = Window.partitionBy("doc_id", "row_id").orderBy("row_pos")
    font = F.avg("height").over(Window.partitionBy("doc_id", "row_id"))
    units = (F.lead("x_start").over(w) - F.col("x_end")) / font + 2
    return order.withColumn("n_blanks", F.coalesce(F.greatest(units.cast("int"), F.lit(0)), F.lit(0)) * 2)


def row_texts(spaced: DataFrame) -> DataFrame:
    """``(doc_id, row_id, text, x_end, font)``: the text of each row."""
    piece = F.concat(F.coalesce("text", F.lit("")), F.expr("repeat(' ', n_blanks)"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("row_pos"), piece.alias("t"))))
    return spaced.groupBy("doc_id", "row_id").agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"), F.max("x_end").alias("x_end"), F.avg("height").alias("font")
    )


def document_text(rows: DataFrame, ends: Column | None = None) -> DataFrame:
    """``(doc_id, text)``: rows in order, a newline after each (or where ``ends``)."""
    tail = F.lit("\n") if ends is None else F.when(ends, F.lit("\n")).otherwise(F.lit(""))
    parts = F.array_sort(F.collect_list(F.struct("row_id", F.concat("text", tail).alias("t"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))


def paragraph_ends(rows: DataFrame, fonts: float = 2.0) -> DataFrame:
    """Adds ``ends``: rows that stop ``fonts`` font sizes or more before the
    rightmost edge of the document end a paragraph."""
    right = F.max("x_end").over(_doc())
    return rows.withColumn("max_x", right).withColumn("ends", F.col("max_x") - F.col("x_end") >= fonts * F.col("font"))


def paragraphs_by_edge(rows: DataFrame, keep_tail: bool = False) -> DataFrame:
    """Adds ``para`` and ``para_pos``: within a paragraph rows are ordered by right
    edge. An unfinished last paragraph is lost unless ``keep_tail``."""
    marked = paragraph_ends(rows)
    before = _doc().orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    p = marked.withColumn("para", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)))
    p = p.withColumn("para_pos", F.row_number().over(Window.partitionBy("doc_id", "para").orderBy("x_end", "row_id")) - 1)
    if keep_tail:
        return p
    return p.withColumn("__done", F.max("ends").over(Window.partitionBy("doc_id", "para"))).where("__done").drop("__done")


def to_text(boxes: DataFrame, few: int = 3) -> DataFrame:
    """``(doc_id, text)``: the whole chain; documents of fewer than ``few`` boxes
    are strung together in input order, each box with a newline.

    One plan for both: in a small document every box is a row of its own without blanks."""
    small = F.count("*").over(_doc()) < few
    g = rows_by_previous(geometry(boxes.withColumn("__small", small)))
    g = g.withColumn("row_id", F.when(F.col("__small"), F.row_number().over(_input()).cast("bigint")).otherwise(F.col("row_id")))
    return document_text(row_texts(gaps(ordered(g))))


def column_at(x: Column, left: Column, mid: Column, right: Column, names: tuple[str, ...]) -> Column:
    """The column of a value at ``x`` under headers at ``left``, ``mid`` and ``right``.

    ``names`` are those of the columns before, between and beyond the headers: left of
    the first header, strictly between it and the middle one, ..., right of the last.
    What is in no such interval belongs to the one of the middle and the last header
    that is nearer, to the one before the last if neither is."""
    before, between, at_mid, rest, beyond = (F.lit(n) for n in names)
    near = F.when(x - mid < right - x, at_mid).otherwise(rest)
    return F.when((left < x) & (x < mid), between).when(x < left, before).when(x > right, beyond).otherwise(near)


def columns_by_header(boxes: DataFrame, headers: DataFrame, names: tuple[str, ...] = ("before", "between", "at_mid", "rest", "beyond")) -> DataFrame:
    """Values to the column they stand in; ``headers`` has ``left_x``, ``mid_x`` and
    ``right_x`` per document (see :func:`column_at`)."""
    j = boxes.join(headers, "doc_id")
    return j.select("doc_id", "box_idx", "text", column_at(F.col("ax"), F.col("left_x"), F.col("mid_x"), F.col("right_x"), names).alias("column_name"))


#: The columns of an itinerary's amounts from left to right, and its header words
#: (the letters that two must share with a box): fixed values.
FEES = ("Ticket_Fee", "Develop_Fee", "Oil_Fee", "Other_Fee", "Total_Fee")
FEE_HEADERS = (("民航发展基金", 2), ("燃油附加费", 2), ("合计", 2))


def fees(boxes: DataFrame, names: tuple[str, ...] = FEES, headers: tuple[tuple[str, int], ...] = FEE_HEADERS) -> DataFrame:
    """``(doc_id, box_idx, category, value)``: the amounts of a page by their place.

    A header is the last box that shares so many characters with its words. Pages
    without all three headers give nothing. On a page with as many amounts as there
    are names they are told by their order from left to right, else by the headers'
    places. Places are those of the first corner; values lose letters and blanks.

    Only headers and amounts are shuffled."""
    text = F.col("text")
    amount = F.coalesce(is_amount_text(text), F.lit(False))
    heads = [F.coalesce(shared_characters(F.lit(words), text) >= least, F.lit(False)) for words, least in headers]
    b = boxes.select("doc_id", "box_idx", "text", "ax", amount.alias("__fee"), *(h.alias(f"__h{i}") for i, h in enumerate(heads)))
    b = b.where(F.col("__fee") | F.col("__h0") | F.col("__h1") | F.col("__h2"))
    last = [F.max(F.when(F.col(f"__h{i}"), F.struct("box_idx", "ax"))).over(_doc())["ax"].alias(f"__x{i}") for i in range(3)]
    b = b.select("doc_id", "box_idx", "text", "ax", "__fee", *last, F.count(F.when(F.col("__fee"), 1)).over(_doc()).alias("__n"))
    b = b.where("__fee and __x0 is not null and __x1 is not null and __x2 is not null")
    rank = F.row_number().over(_doc().orderBy("ax", "box_idx"))
    by_place = column_at(F.col("ax"), F.col("__x0"), F.col("__x1"), F.col("__x2"), names)
    b = b.withColumn("__r", rank).withColumn("category", F.when(F.col("__n") == len(names), F.get(F.array(*map(F.lit, names)), F.col("__r") - 1)).otherwise(by_place))
    return b.select("doc_id", "box_idx", "category", without_letters(text).alias("value"))


def columns_by_rank(boxes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Values to columns by their order from left to right, in documents that
    have exactly as many values as there are names."""
    w = Window.partitionBy("doc_id").orderBy("x_center", "box_idx")
    b = boxes.withColumn("__n", F.count("*").over(_doc())).where(F.col("__n") == len(names)).withColumn("__r", F.row_number().over(w))
    return b.select("doc_id", "box_idx", "text", F.element_at(F.array(*map(F.lit, names)), F.col("__r")).alias("column_name"))
