"""Nested payloads against a plain walk over parsed JSON, and the odd shapes."""

import json

import pytest

from docloom.operators import nested


def walk(payload):
    listed = lambda i: [i] if isinstance(i, dict) else i if isinstance(i, list) else []
    out = {}

    def boxes(path, info, parent):
        for k, b in enumerate(listed(info)):
            if isinstance(b, dict):
                out[f"{path}.{k}"] = parent
                boxes(f"{path}.{k}", b.get("info"), f"{path}.{k}")

    try:
        v = json.loads(payload)
    except (TypeError, ValueError):
        return out
    pages = v if isinstance(v, list) else v["r_ls"] if isinstance(v, dict) and isinstance(v.get("r_ls"), list) else [v]
    for n, page in enumerate(pages):
        result = page.get("result") if isinstance(page, dict) else None
        if isinstance(result, str):
            try:
                result = json.loads(result)
            except ValueError:
                result = None
        if isinstance(result, dict):
            boxes(str(n), result.get("info"), None)
    return out


def test_all_payloads(spark, data):
    df = spark.read.parquet(f"{data}/ocr_raw.parquet")
    got = {(r.raw_id, r.box_path): r.parent_path for r in nested.boxes(df).collect()}
    want = {(r.raw_id, p): parent for r in df.collect() for p, parent in walk(r.payload).items()}
    assert got == want


ODD = {
    "null": (None, []), "empty": ("", []), "blank": ("  ", []), "json null": ("null", []), "number": ("3", []), "text": ('"x"', []),
    "cut off": ('{"result":{"info":[{}', []), "trailing": ('{"result":{"info":[{}]}} x', []), "trailing bracket": ('{"result":{"info":[{}]}}]', []),
    "trailing brace": ('{"result":{"info":[{}]}}}', []), "two values": ('{"result":{"info":[{}]}},{"result":{"info":[{}]}}', []),
    "single object": ('{"result":{"info":{"text":1}}}', ["0.0"]), "nulls count": ('{"result":{"info":[null,"x",[{}],{}]}}', ["0.3"]),
    "text result": ('{"result":"{\\"info\\":[{}]}"}', ["0.0"]), "bad text result": ('{"result":"{"}', []), "pages": ('[null,{"result":{"info":[{}]}}]', ["1.0"]),
    "r_ls": ('{"r_ls":[{"result":{"info":[{}]}},3,{"result":{"info":{}}}]}', ["0.0", "2.0"]),
    "inner": ('{"result":{"info":[{"info":{"info":[null,{}]}}]}}', ["0.0", "0.0.0", "0.0.0.1"]), "same again": ('{"result":{"info":{"text":1}}}', ["0.0"]),
}


def test_odd_payloads(spark):
    rows = [(i, p, "extra") for i, (p, _) in enumerate(ODD.values())]
    df = spark.createDataFrame(rows, "raw_id long, payload string, box_path string")
    got = {}
    for r in nested.boxes(df).collect():
        got.setdefault(r.raw_id, []).append(r.box_path)
    for i, (name, (_, want)) in enumerate(ODD.items()):
        assert sorted(got.get(i, [])) == want, name


def test_fields_and_points(spark):
    p = json.dumps({"result": {"info": [{"text": 7, "score": "0.5", "coord": [{"x": 1, "y": 2}, [3, 4], None, "z"]}, {"text": None, "score": None, "coord": None}]}})
    df = spark.createDataFrame([(1, p)], "raw_id long, payload string")
    assert [(r.text, r.score) for r in nested.boxes(df).orderBy("box_path").collect()] == [("7", 0.5), (None, None)]
    assert [(r.box_path, r.point_index, r.x, r.y) for r in nested.points(df).collect()] == [("0.0", 0, 1.0, 2.0), ("0.0", 1, 3.0, 4.0)]
    assert nested.responses(df).first().n_elements == 2


def test_missing_responses_are_rows(spark):
    df = spark.createDataFrame([(1, None), (2, '[null,{"error":"","result":{"message":"success"}}]')], "raw_id long, payload string")
    got = {(r.raw_id, r.page, r.message) for r in nested.responses(df, missing=True).collect()}
    assert got == {(1, 0, None), (2, 0, None), (2, 1, "success")}


def test_empty_table(spark):
    df = spark.createDataFrame([], "raw_id long, payload string")
    assert nested.boxes(df).count() == nested.points(df).count() == nested.responses(df).count() == 0


def test_many_boxes_and_too_deep(spark):
    wide = json.dumps({"result": {"info": [{"text": "x" * 50}] * 5000}})
    assert nested.boxes(spark.createDataFrame([(1, wide)], "raw_id long, payload string")).count() == 5000
    deep = '{"result":' + '{"info":' * 5 + "{}" + "}" * 6
    df = spark.createDataFrame([(1, deep)], "raw_id long, payload string")
    assert nested.boxes(df, depth=5).count() == 5
    with pytest.raises(Exception, match="deeper"):
        nested.boxes(df, depth=4).collect()
