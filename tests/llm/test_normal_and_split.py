"""Problems 1 and 6."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import queries, splitting, textform, variants

BREAK = textform.LINE_BREAK


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("ＡＢ１２，：", "AB12,:"), ("a​b﻿­", "ab"), ("a b　c", "a b c"), ("⼀金", "一金"), ("José", "José"),
        ("СТ室", "CT室"), ("ЕΙСU", "EICU"), ("K1", "K1"), ("5µmol", "5μmol"), ("μmol/L", "μmol/L"), ("α-淀粉酶 β2 γ", "α-淀粉酶 β2 γ"),
        ("。、《é》", "。、《é》"), ("", ""), ("nоidе", "noide"),
        ("сор", "cop"), ("рок и сор", "рок и сор"), ("жук, сор", "жук, сор"), ("γ ΕΙ β", "γ EI β"), ("λόγος ον", "λόγος ον"), ("ICU сор", "ICU cop"), ("аԁmіn", "admin"), ("Ⅲ度 ⅳ", "III度 iv"), ("𝐀𝟏", "A1"), ("丽", "丽"),
    ],
)
def test_one_form(raw, plain):
    assert textform.canon(raw) == plain
    assert textform.canon(plain) == plain
    assert textform.has_variant(raw) == (raw != plain)


def test_alignment():
    text, at = textform.canon_aligned(["Jo", "se", "́", None, "", BREAK, "​", "ﬁ"])
    assert text == "José\nfi" and at == [0, 0, 1, 1, 5, 7, 7]


def test_variants_in_tables(spark):
    rows = [(1, ["a", None, "", " "]), (2, ["Ａ"]), (3, None), (4, []), (5, ["x", "́"]), (2, ["Ａ"])]
    df = spark.createDataFrame(rows, "example_id long, words array<string>").withColumn("row_id", F.lit("clash"))
    found = variants.find_variants(df.where("words is not null"), "example_id", variants.joined_words(F.col("words")), "examples")
    assert sorted(map(tuple, found.collect())) == [("examples", 2), ("examples", 5)]
    words = {r.example_id: r.words for r in variants.normalize_words(df).collect()}
    assert words == {1: ["a", None, "", " "], 2: ["A"], 3: None, 4: [], 5: ["x", "́"]} or words[5] == ["x́"[:1], ""]
    long = spark.createDataFrame([("ｘ" * 100_000,), (None,), ("",)], "value string")
    assert [len(r.value) if r.value is not None else None for r in variants.normalize_text(long, "value").collect()] == [100_000, None, 0]


def pieces_of(spark, words, **kw):
    df = spark.createDataFrame([(1, words)], "example_id long, words array<string>")
    return splitting.split_words(df, "example_id", **kw).orderBy("piece").collect()


def test_split_limits_and_overlap(spark):
    words = (list("今天好。") + [BREAK]) * 30 + ["", None, " "] + ["x"] * 100
    got = pieces_of(spark, words, limit=40, overlap=5)
    solid = [w for w in words if w and w.strip()]
    back = []
    for r in got:
        own = [w for w in r.piece_words if w and w.strip()]
        assert 0 < len(own) <= 40
        if back:
            assert own[:5] == back[-5:]
        back += own[5 if back else 0 :]
    assert back == solid
    assert got[0].piece_words[-1] == BREAK
    assert got[0].start_word == 0 and got[-1].end_word == len(words)


def test_split_levels():
    assert splitting.cut(list("一二三。四五六七"), 6, 1) == [(0, 4), (3, 8)]
    assert splitting.cut(list("一二三,四五六七"), 6, 1) == [(0, 4), (3, 8)]
    assert splitting.cut(list("abcdefgh"), 4, 1) == [(0, 4), (3, 7), (6, 8)]
    assert splitting.strength(BREAK, BREAK) > splitting.strength(BREAK, "a") > splitting.strength("。", "a") > splitting.strength(",", "a") > splitting.strength("a", "b")


def test_no_degenerate_pieces():
    """A section end does not leave a piece that adds next to nothing."""
    words = ["a"] * 80 + [BREAK, BREAK] + ["b"] * 300
    assert splitting.cut(words, 200, 20) == [(0, 82), (62, 262), (242, 382)]
    assert splitting.cut(["a", "。", *["b"] * 300], 200, 20) == [(0, 200), (180, 302)]


def test_recursion_and_packing():
    """Whole paragraphs are packed; one that is too long is split at its sentences."""
    line, long = [*"今天好", BREAK], [*("很好。" * 30), BREAK]
    words = line * 3 + long + line * 3
    got = splitting.cut(words, 40, 4)
    assert got[0] == (0, 39)  # three paragraphs and nine sentences
    assert all(words[b - 1] in ("。", BREAK) for _, b in got)
    import random

    rng = random.Random(5)
    for _ in range(300):
        words = rng.choices(["a", "b", "，", "。", BREAK], weights=[8, 8, 2, 1, 1], k=rng.randint(1, 400))
        limit = rng.randint(2, 60)
        overlap = rng.randrange(limit)
        spans = splitting.cut(words, limit, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(words) and all(0 < b - a <= limit for a, b in spans)
        assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(spans, spans[1:]))


def test_only_oversized_items_reach_python(spark, tmp_path):
    """The function sees the words of items over the limit, others are nulls; the plan has it once."""
    df = spark.createDataFrame([(i, ["x"] * (300 if i == 7 else 20)) for i in range(50)], "example_id long, words array<string>")
    out = splitting.split_words(df, "example_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    assert {r.example_id: r.n_pieces for r in out.collect()} == {i: 2 if i == 7 else 1 for i in range(50)}


def test_split_edges(spark):
    rows = [(1, None), (2, []), (3, [None, "", " "]), (4, ["a"] * 254), (5, ["a"] * 255), (5, ["a"] * 255)]
    df = spark.createDataFrame(rows, "example_id long, words array<string>").withColumn("piece", F.lit("clash"))
    got = splitting.split_words(df, "example_id").groupBy("example_id").count().collect()
    assert {r.example_id: r["count"] for r in got} == {2: 1, 3: 1, 4: 1, 5: 4}
    assert splitting.split_words(df.limit(0), "example_id").count() == 0
    with pytest.raises(ValueError):
        splitting.split_words(df, "example_id", limit=10, overlap=10)


def test_split_text(spark):
    texts = ["", "short", "你好。hello world. " * 400, "x" * 5000, None, "\n" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for i, t in enumerate(texts):
        rows = splitting.split_text(df.where(F.col("doc_id") == i), "doc_id", limit=300, overlap=20).orderBy("piece").collect()
        if t is None:
            assert not rows
            continue
        assert all(len(r.piece_text) <= 300 for r in rows)
        back = rows[0].piece_text
        for r in rows[1:]:
            assert r.start_char == len(back) - 20
            back += r.piece_text[20:]
        assert back == t


def test_p1_against_sql(compare):
    from docloom.llm import sql

    for name, q in sql.oracle_sql().items():
        compare(queries.queries()[name], q)


def test_queries_give_rows(spark, data):
    for name, q in queries.queries().items():
        df = q(spark, data)
        assert len(set(df.columns)) == len(df.columns)
        assert df.count() > 0, name
