"""SQL of the boxes in the payloads, shared by several queries."""

from __future__ import annotations


def listed(value: str, path: str) -> str:
    return f"""CASE json_type({value}, '{path}') WHEN 'ARRAY' THEN from_json({value} -> '{path}', '["json"]') WHEN 'OBJECT' THEN [{value} -> '{path}'] END"""


BOXES = f"""
parsed AS (SELECT raw_id, payload::JSON AS p FROM ocr_raw WHERE json_valid(payload)),
lists AS (SELECT raw_id, CASE json_type(p) WHEN 'ARRAY' THEN from_json(p, '["json"]') WHEN 'OBJECT' THEN coalesce({listed('p', '$.r_ls')}, [p]) END AS l FROM parsed),
pages AS (SELECT raw_id, i::INTEGER AS page, l[i + 1] AS x FROM (SELECT raw_id, l, unnest(range(len(l))) AS i FROM lists)),
res AS (SELECT raw_id, page, x, CASE json_type(x, '$.result') WHEN 'VARCHAR' THEN CASE WHEN json_valid(x ->> '$.result') THEN (x ->> '$.result')::JSON END ELSE x -> '$.result' END AS r FROM pages WHERE json_type(x) = 'OBJECT'),
boxes(raw_id, page, box_path, parent_path, level, box_index, b) AS (
  SELECT raw_id, page, page || '.' || i, NULL::VARCHAR, 0, i::INTEGER, l[i + 1] FROM (SELECT raw_id, page, l, unnest(range(len(l))) AS i FROM (SELECT raw_id, page, {listed('r', '$.info')} AS l FROM res)) WHERE json_type(l[i + 1]) = 'OBJECT'
  UNION ALL
  SELECT raw_id, page, box_path || '.' || i, box_path, level + 1, i::INTEGER, l[i + 1] FROM (SELECT raw_id, page, box_path, level, l, unnest(range(len(l))) AS i FROM (SELECT raw_id, page, box_path, level, {listed('b', '$.info')} AS l FROM boxes)) WHERE json_type(l[i + 1]) = 'OBJECT')"""

#: Boxes with their place in the payload and their corners; ``geo`` holds those that have all four.
CORNERS = BOXES + """,
crn AS (SELECT raw_id, page, raw_id || '.' || page AS doc_id, (row_number() OVER (PARTITION BY raw_id ORDER BY page, string_split(box_path, '.')::INTEGER[]) - 1)::INTEGER AS box_idx,
  b ->> '$.text' AS text, try_cast(b ->> '$.score' AS DOUBLE) AS score, """ + ", ".join(
    f"coalesce(try_cast(b ->> '$.coord[{i}].{k}' AS DOUBLE), try_cast(b ->> '$.coord[{i}][{j}]' AS DOUBLE)) AS {k}{i}" for i in range(4) for j, k in enumerate("xy")
) + """ FROM boxes),
geo AS (SELECT doc_id, box_idx, text, x0 AS ax, least(y0, y1, y2, y3) AS min_y, (y0 + y1 + y2 + y3) / 4 AS avg_y, (x0 + x3) / 2 AS x_start, (x1 + x2) / 2 AS x_end,
  (x0 + x1 + x2 + x3) / 4 AS x_center, ((y2 - y1) + (y3 - y0)) / 2 AS height FROM crn
  WHERE x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL AND x3 IS NOT NULL AND y3 IS NOT NULL)"""

#: Texts of the payloads and of the documents (the first delivery that has boxes).
TEXTS = BOXES + """,
rtx AS (SELECT raw_id, coalesce(string_agg(b ->> '$.text', chr(10) ORDER BY page, string_split(box_path, '.')::INTEGER[]), '') AS text FROM boxes GROUP BY raw_id),
dtx AS (SELECT doc_id, text FROM (SELECT doc_id, raw_id, text FROM rtx JOIN ocr_raw USING (raw_id)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY raw_id) = 1)"""
