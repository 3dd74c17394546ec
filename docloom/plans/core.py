"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from docloom.operators import nested
from docloom.plans import spans, tags, texts
from docloom.plans.payloads import BOXES, listed
from docloom.session import read


def p4_found(spark, sf_dir):
    """Every box in the payloads with the path of indices that leads to it; a path is
    unique within its payload, so nothing is shuffled."""
    return nested.boxes(read(spark, sf_dir, "ocr_raw")).select("raw_id", "box_path")


def p4_responses(spark, sf_dir):
    return nested.responses(read(spark, sf_dir, "ocr_raw"))


def p4_boxes(spark, sf_dir):
    return nested.boxes(read(spark, sf_dir, "ocr_raw"))


def p4_points(spark, sf_dir):
    return nested.points(read(spark, sf_dir, "ocr_raw"))


SQL = {
    "p4_found": f"WITH RECURSIVE {BOXES} SELECT DISTINCT raw_id, box_path FROM boxes",
    "p4_boxes": f"WITH RECURSIVE {BOXES} SELECT raw_id, page, box_path, parent_path, level, box_index, b ->> '$.text' AS text, try_cast(b ->> '$.score' AS DOUBLE) AS score FROM boxes",
    "p4_responses": f"""WITH RECURSIVE {BOXES} SELECT raw_id, page, x ->> '$.error' AS error, r ->> '$.message' AS message, coalesce(len({listed('r', '$.info')}), 0)::INTEGER AS n_elements FROM res""",
    "p4_points": f"""WITH RECURSIVE {BOXES}, pts AS (SELECT raw_id, box_path, i::INTEGER AS point_index, l[i + 1] AS p FROM (SELECT raw_id, box_path, l, unnest(range(len(l))) AS i FROM (SELECT raw_id, box_path, CASE WHEN json_type(b, '$.coord') = 'ARRAY' THEN from_json(b -> '$.coord', '["json"]') END AS l FROM boxes))),
xy AS (SELECT raw_id, box_path, point_index, coalesce(try_cast(p ->> '$.x' AS DOUBLE), try_cast(p ->> '$[0]' AS DOUBLE)) AS x, coalesce(try_cast(p ->> '$.y' AS DOUBLE), try_cast(p ->> '$[1]' AS DOUBLE)) AS y FROM pts)
SELECT * FROM xy WHERE x IS NOT NULL OR y IS NOT NULL""",
}


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_responses, p4_boxes, p4_points)} | tags.QUERIES | texts.QUERIES | spans.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | tags.SQL | texts.SQL | spans.SQL
