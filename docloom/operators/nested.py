"""Deeply nested semi-structured responses to flat, linked tables.

Higher-order projection: nested ``transform`` calls walk pages, boxes and boxes
within boxes and attach ancestor keys and indices to each element, ``flatten``
combines the arrays, and one ``inline`` per target table emits its rows. All of
it runs in the JVM on ``VARIANT`` values, so a field may be missing, null or of
another type or shape in every record.

Defined results: null, empty, blank, cut-off or otherwise invalid payloads give
no rows (trailing matter after a valid value makes it invalid); null or
non-object elements are counted by the indices but are no rows; an ``info`` that
is one object counts as a list of one; ``result`` may be JSON text. Boxes nested
below ``depth`` levels raise an error rather than getting lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrays import let
from docloom.session import spread

DEPTH = 16


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _listed(v: Column, path: str) -> Column:
    """The list at ``path``; a single object counts as a list of one."""
    return let(_get(v, path, "variant"), lambda x: F.coalesce(_get(x, "$", "array<variant>"), F.when(_kind(x, "OBJECT"), F.array(x))))


def parse_whole(payload: Column) -> Column:
    """The variant of a complete, valid JSON text, else null.

    The JSON reader stops after the first value; wrapping the text in both
    kinds of brackets makes anything that follows an error."""
    listed = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), payload, F.lit("}")))
    return let(listed, lambda x: F.when(_get(x, "$[1]", "variant").isNull() & named.isNotNull(), _get(x, "$[0]", "variant")))


def pages_of(value: Column) -> Column:
    """The responses of a payload: a bare list, one under ``r_ls``, or itself."""
    return F.coalesce(
        _get(value, "$", "array<variant>"), _listed(value, "$.r_ls"), F.when(_kind(value, "OBJECT"), F.array(value))
    )


def result_of(page: Column) -> Column:
    """``result`` of a response, parsed when it is JSON text."""
    return let(_get(page, "$.result", "variant"), lambda x: F.when(_kind(x, "STRING"), F.try_parse_json(_get(x, "$", "string"))).otherwise(x))


def _box(box: Column, page: Column, path: Column, parent: Column, index: Column, level: int) -> Column:
    return F.struct(
        page.alias("page"), path.alias("box_path"), parent.alias("parent_path"), F.lit(level).alias("level"),
        index.alias("box_index"), box.alias("box"),
    )


def _boxes(boxes: Column, page: Column, parent: Column, depth: int, level: int = 0) -> Column:
    """Boxes of one ``info`` list and of every list within, parents first."""

    def one(box: Column, i: Column) -> Column:
        path = F.concat_ws(".", F.coalesce(parent, page.cast("string")), i.cast("string"))
        own = F.array(_box(box, page, path, parent, i, level))
        inner = _listed(box, "$.info")
        if level + 1 < depth:
            # the deeper levels stand once in the expression, so it grows
            # linearly with the depth
            rows = F.concat(own, F.coalesce(_boxes(inner, page, path, depth, level + 1), F.slice(own, 1, 0)))
        else:
            stop = F.raise_error(F.lit("boxes are nested deeper than the depth allowed")).cast("boolean")
            rows = F.filter(own, lambda x: F.when(F.exists(inner, lambda y: _kind(y, "OBJECT")), stop).otherwise(F.lit(True)))
        return F.when(_kind(box, "OBJECT"), rows)

    return F.flatten(F.filter(F.transform(boxes, one), lambda x: x.isNotNull()))


def _parsed(df: DataFrame, key: str, payload: str) -> DataFrame:
    rows = spread(df.select(F.col(key).alias("__key"), F.col(payload).alias("__payload")).where("__payload is not null"))
    return rows.select("__key", let(parse_whole(F.col("__payload")), pages_of).alias("__pages"))


def responses(df: DataFrame, key: str = "raw_id", payload: str = "payload", missing: bool = False) -> DataFrame:
    """``(key, page, error, message, n_elements)``: one row per response object.

    With ``missing``, null or non-object responses and unreadable payloads are
    rows too, with error and message null."""

    def row(p: Column, i: Column) -> Column:
        return F.struct(
            i.cast("int").alias("page"), _get(p, "$.error", "string").alias("error"), _get(result_of(p), "$.message", "string").alias("message"),
            F.coalesce(F.size(_listed(result_of(p), "$.info")), F.lit(0)).alias("n_elements"),
        )

    if missing:
        pages = let(parse_whole(F.col(payload)), pages_of)
        rows = F.transform(F.coalesce(pages, F.array(F.lit(None).cast("variant"))), row)
        return df.select(F.col(key), F.inline(rows))
    rows = F.transform("__pages", lambda p, i: F.when(_kind(p, "OBJECT"), row(p, i)))
    return _parsed(df, key, payload).select(F.col("__key").alias(key), F.inline(F.filter(rows, lambda x: x.isNotNull())))


def _flat_boxes(depth: int) -> Column:
    """The boxes of all pages of ``__pages`` in order, each after the one around it."""
    pages = F.transform("__pages", lambda p, i: _boxes(_listed(result_of(p), "$.info"), i, F.lit(None).cast("string"), depth))
    return F.flatten(F.filter(pages, lambda x: x.isNotNull()))


def _all_boxes(df: DataFrame, key: str, payload: str, depth: int) -> DataFrame:
    return _parsed(df, key, payload).select(F.col("__key").alias(key), F.inline(_flat_boxes(depth)))


def payload_texts(df: DataFrame, key: str = "raw_id", payload: str = "payload", depth: int = DEPTH) -> DataFrame:
    """``(key, text)`` of the payloads with boxes: the texts of all boxes in order, a
    newline between two; boxes without text are left out. No shuffle."""
    def joined(b: Column) -> Column:
        text = F.array_join(F.transform(b, lambda x: _get(x["box"], "$.text", "string")), "\n")
        return F.when(F.size(b) > 0, F.array(text))

    # a generator, as a filter on the boxes would have them built twice
    return _parsed(df, key, payload).select(F.col("__key").alias(key), F.explode(let(_flat_boxes(depth), joined)).alias("text"))


def boxes(df: DataFrame, key: str = "raw_id", payload: str = "payload", depth: int = DEPTH) -> DataFrame:
    """``(key, page, box_path, parent_path, level, box_index, text, score)``: one
    row per box at any depth, linked to its response and its enclosing box."""
    b = F.col("box")
    return _all_boxes(df, key, payload, depth).select(
        key, "page", "box_path", "parent_path", "level", "box_index", _get(b, "$.text", "string").alias("text"), _get(b, "$.score", "double").alias("score")
    )


def points(df: DataFrame, key: str = "raw_id", payload: str = "payload", depth: int = DEPTH) -> DataFrame:
    """``(key, box_path, point_index, x, y)``: one row per corner, given as an
    object with x and y or as a pair."""
    coord = _get(F.col("box"), "$.coord", "array<variant>")
    rows = F.transform(
        coord,
        lambda p, i: F.struct(
            i.alias("point_index"), F.coalesce(_get(p, "$.x", "double"), _get(p, "$[0]", "double")).alias("x"),
            F.coalesce(_get(p, "$.y", "double"), _get(p, "$[1]", "double")).alias("y"),
        ),
    )
    return _all_boxes(df, key, payload, depth).select(key, "box_path", F.inline(rows)).where("x is not null or y is not null")


def box_corners(df: DataFrame, key: str = "raw_id", payload: str = "payload", depth: int = DEPTH) -> DataFrame:
    """As :func:`boxes` with the four corners as columns ``ax ay bx by cx cy dx dy``,
    read in the same pass (null where a corner is missing), and with ``box_no``, the
    place of the box among all of its payload."""
    b = F.col("box")
    corner = [
        F.coalesce(_get(b, f"$.coord[{i}].{k}", "double"), _get(b, f"$.coord[{i}][{j}]", "double")).alias(f"{n}{k}")
        for i, n in enumerate("abcd")
        for j, k in enumerate("xy")
    ]
    rows = _parsed(df, key, payload).select(F.col("__key").alias(key), F.posexplode(_flat_boxes(depth)).alias("box_no", "__b")).select(key, "box_no", "__b.*")
    return rows.select(
        key, "page", "box_no", "box_path", "level", "box_index", _get(b, "$.text", "string").alias("text"), _get(b, "$.score", "double").alias("score"), *corner
    )
