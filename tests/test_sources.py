"""Readers, writers and the stream."""

from pyspark.sql import functions as F

from docloom.plans import spans as span_plans
from docloom.plans import tags
from docloom.sources import readers, sinks
from docloom.streaming import pipeline

CONLL = "a B-X\nb I-X\n\n\nc\n-DOCSTART- x\nd O"


def parsed(df):
    return sorted((r.doc_no, r.pos, r.token, r.label) for r in df.collect())


def test_tagged_lines_tail(spark):
    df = spark.createDataFrame([(1, CONLL)], "k int, text string")
    kept = parsed(readers.tagged_lines(df, "k"))
    assert kept == [(0, 0, "a", "B-X"), (0, 1, "b", "I-X"), (1, 0, "c", "O"), (2, 0, "d", "O")]
    assert parsed(readers.tagged_lines(df, "k", keep_tail=False)) == kept[:3]
    exact = parsed(readers.tagged_lines(df, "k", separators="exact", keep_empty=True, keep_tail=False))
    assert exact == [(0, 0, "a", "B-X"), (0, 1, "b", "I-X")]


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text(CONLL)
    assert readers.read_tagged(spark, str(tmp_path / "t")).count() == 4
    one = readers.read_one_per_file(spark, str(tmp_path / "t")).first()
    assert one.tokens[:2] == ["a", "b"]
    (tmp_path / "p.tsv").write_text(" x y \tl\n")
    assert tuple(readers.read_pairs(spark, str(tmp_path / "p.tsv")).first()) == ("x y", "l")
    (tmp_path / "s.log").write_text("2020-01-01 10:00:00,1 - INFO - web - took 1.5\nnoise\n")
    assert readers.read_log(spark, str(tmp_path / "s.log")).first().logger == "web"
    (tmp_path / "j" / "k").mkdir(parents=True)
    (tmp_path / "j" / "k" / "r.json").write_text('{"error":""}')
    (tmp_path / "j" / "k" / "r.txt").write_text("no")
    assert readers.read_responses(spark, str(tmp_path / "j")).count() == 1
    (tmp_path / "q.json").write_text('{"data":[{"id":"1","paragraphs":[{"context":"abc","qas":[{"id":"q","question":"?","answers":[{"text":"b"}]}]}]}]}')
    from docloom.operators import spans

    assert spans.questions(readers.read_questions(spark, str(tmp_path / "q.json"))).first().answer_start == 1


def test_labels(spark):
    df = spark.createDataFrame([("B-X\nI-X\n",), ("O\nB-X",)], "t string")
    assert [r[0] for r in df.select(readers.labels_of(F.col("t"))).collect()] == [["O", "B-X", "I-X"], ["O", "B-X"]]


def test_key_values(spark):
    df = spark.createDataFrame([(1, "Flight_Number: ca1,ca2\nName:a b\nnoise\nX:")], "k int, text string")
    got = {(r.category, r.value) for r in readers.read_key_values(df, "k").collect()}
    assert got == {("Flight_Number", "CA1"), ("Flight_Number", "CA2"), ("Name", "AB")}


def test_sheet_values(spark):
    df = spark.createDataFrame([(1.25, "甲，乙（x） ", None)], "fee double, note string, none string")
    assert tuple(readers.table_values(df, amounts=("fee",)).first()) == ("1.2", "甲,乙(X)", "")


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([(1, 0, "a", "B-X"), (1, 1, "b", None)], "doc_id long, pos int, token string, label string")
    assert sinks.tagged_text(t).first().text == "a B-X\nb O\n\n"
    kv = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    sinks.write_lines(sinks.key_values(kv, "k", "v"), str(tmp_path / "kv"))
    assert spark.read.text(str(tmp_path / "kv")).count() == 2
    sinks.write_csv(kv, str(tmp_path / "csv"), drop="b")
    assert {r.k for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {None, "a"}
    sinks.write_splits(kv.withColumn("split", F.lit("dev")), str(tmp_path / "sp"))
    assert spark.read.parquet(str(tmp_path / "sp")).first().split == "dev"
    assert sinks.write_features(kv, str(tmp_path / "f")).count() == 2
    assert sinks.write_features(kv.limit(0), str(tmp_path / "f")).count() == 2
    line = spark.createDataFrame([(["a", "b"], ["x", "y"])], "t array<string>, l array<string>").select(sinks.pair_line(F.col("t"), F.col("l"))).first()[0]
    assert line == "a b \t x y"


def test_stream_equals_batch(spark, data):
    got = {tuple(r) for r in span_plans.stream_codes(spark, data).select("code", "responses").collect()}
    batch = pipeline.codes(spark.read.parquet(f"{data}/ocr_raw.parquet")).groupBy("code").count()
    assert got == {tuple(r) for r in batch.collect()}


def test_repeated_deliveries_and_late_windows(spark, data, tmp_path):
    like = spark.read.parquet(f"{data}/ocr_raw.parquet")
    stream = pipeline.read_stream(spark, f"{data}/ocr_raw.parquet", like).withColumn("received_at", F.col("received_at").cast("timestamp"))
    out = str(tmp_path / "once")
    pipeline.run(pipeline.once(stream, ["doc_id"]).select("raw_id", "doc_id"), out, out + "-log")
    assert spark.read.parquet(out).count() == like.select("doc_id").distinct().count()


def test_id_texts(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("/a/b/12ab.txt.ann\tx y z\n")
    assert tuple(readers.read_id_texts(spark, str(tmp_path / "x.tsv")).first()) == ("12ab", "xyz")


def test_files_and_run_codes(spark, tmp_path):
    for name, content in {"a/log.json": '[{"code": "10002"}]', "a/1.png": "x", "b/c/2.png": "yy", "d/log.json": "broken", "e/log.json": '[{"code": "200"}]'}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)
    got = {r.folder.rsplit(tmp_path.name + "/", 1)[1]: r.code for r in readers.read_run_codes(spark, str(tmp_path)).collect()}
    assert got == {"a": "10002", "b/c": None, "d": None, "e": "200"}
    images = readers.read_files(spark, str(tmp_path), "*.png")
    assert {(r.name, bytes(r.content)) for r in images.collect()} == {("1.png", b"x"), ("2.png", b"yy")}


def test_sheets_of_any_encoding(spark, tmp_path):
    lines = "航班号:ca 12,MU3\n姓名:张三\nno colon\nDate: 01may"
    for name, data in {"a.correct": lines.encode(), "b.correct": lines.encode("gb18030"), "c.correct": b"\xef\xbb\xbf" + lines.encode(), "d.correct": lines.encode("utf-16"), "bad.correct": b"x:y", "e.txt": b"x:y"}.items():
        (tmp_path / name).write_bytes(data)
    got = readers.read_sheets(spark, str(tmp_path), spark.createDataFrame([("bad",)], "id string"))
    assert {(r.id, r.category, r.value) for r in got.collect()} == {(i, *x) for i in "abcd" for x in (("航班号", "CA12"), ("航班号", "MU3"), ("姓名", "张三"), ("Date", "01MAY"))}


def test_records_round_trip(spark, tmp_path):
    from docloom.sources import records

    rows = [(1, [101, 7, 102], [], None), (2**40, [-5, 2**62], [0] * 200, 3), (-1, [], [1], 0)]
    df = spark.createDataFrame(rows, "unique_ids long, input_ids array<long>, mask array<int>, no_answers int").repartition(2)
    written = records.write_records(df, f"file://{tmp_path}/r", *df.columns)
    assert sum(r.records for r in written.collect()) == 3
    back = records.read_records(spark, f"{tmp_path}/r", [*df.columns, "missing"])
    got = sorted((r.unique_ids, r.input_ids, r.mask, r.no_answers, r.missing) for r in back.collect())
    assert got == sorted(([a], b, c, None if d is None else [d], None) for a, b, c, d in rows)
    assert records.checksum(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    data = records.frame(records.message({"a": [1]}))
    for broken in (data[:-1], data[:5], data[:13] + b"x" + data[14:]):
        try:
            list(records.bodies(broken))
        except ValueError:
            continue
        raise AssertionError("a broken record was read")


def test_dumps_by_category(spark, tmp_path):
    v = spark.createDataFrame([(0, "n", ["b", "a"]), (1, "n", []), (1, "d", ["x"])], "doc_id int, category string, values array<string>")
    sinks.write_by(sinks.set_lines(v), str(tmp_path / "d"))
    got = {(r.category, r.value) for r in spark.read.text(str(tmp_path / "d")).collect()}
    assert got == {("n", "1 n:a,b"), ("n", "2 n:"), ("d", "2 d:x")}


def test_predicted_lines_meet_by_document(spark, data):
    """Texts and predictions join before they are unfolded, and never through the driver."""
    texts = spark.createDataFrame([(1, ["a", None, "c"]), (2, ["d"]), (3, []), (4, None), (5, ["e"])], "doc_id long, words array<string>")
    labels = spark.createDataFrame([(1, ["B-X", "I-X"]), (2, [None, "O"]), (3, ["O"]), (4, ["O"]), (6, ["O"])], "doc_id long, labels array<string>")
    got = sorted(map(tuple, sinks.predicted(texts, labels).collect()))
    assert got == [(1, 0, "a", "B-X"), (1, 1, None, "I-X"), (2, 0, "d", None)]
    plan = tags.predicted_lines(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.index("Generate") < plan.index("SortMergeJoin")
