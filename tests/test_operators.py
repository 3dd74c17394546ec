"""Golden cases of the operators, one per quirk."""

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import arrays, normalize, text
from docloom.operators import assign, bio, datasets, envelope, layout, match, metrics, scoring, spans, values
from docloom.session import cut_lineage, spread


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


def tokens(spark, words, tags):
    rows = [(1, i, w, t) for i, (w, t) in enumerate(zip(words, tags))]
    return spark.createDataFrame(rows, "doc_id long, pos int, token string, label string")


def test_untyped_decoding(spark):
    t = tokens(spark, "abcdefgh", ["B-X", "I-X", "O", "I-X", "B-Y", "B-X", "I-Y", "O"])
    got = {(r.category, r.value) for r in bio.decode(t).collect()}
    assert got == {("X", "ab"), ("Y", "e"), ("X", "fg")}


def test_glued_category(spark):
    h = "Hospital_Name"
    one = tokens(spark, "abc", [f"B-{h}", f"I-{h}", f"B-{h}"])
    assert [r.value for r in bio.decode(one, glue=h).collect()] == ["abc"]
    two = tokens(spark, "abcd", [f"B-{h}", f"I-{h}", f"B-{h}", f"B-{h}"])
    assert sorted(r.value for r in bio.decode(two, glue=h).collect()) == ["abc", "d"]


def test_typed_offsets(spark):
    t = tokens(spark, "abcde", ["B-X", "B-X", "I-X", "I-Y", "B-Y"])
    got = {(r.category, r.start, r.end, r.value) for r in bio.decode_typed(t).collect()}
    assert got == {("X", 0, 1, "a"), ("X", 1, 3, "bc"), ("Y", 4, 5, "e")}


def test_id_decoding_loses_the_last(spark):
    rows = [(1, i, w, t) for i, (w, t) in enumerate(zip("abcd", [2, 3, 0, 2]))]
    t = spark.createDataFrame(rows, "doc_id long, pos int, token string, tag int")
    assert [r.value for r in bio.decode_ids(t).collect()] == ["ab"]
    assert sorted(r.value for r in bio.decode_ids(t, keep_last=True).collect()) == ["ab", "d"]


def test_containment(spark):
    assert col(spark, ["AB", "ABC", "D", "D"], assign.contained_out, "array<string>") == ["ABC"]
    assert col(spark, ["D"], assign.contained_out, "array<string>") == ["D"]


def test_case_variants(spark):
    df = spark.createDataFrame([(1, "Ab"), (1, "AB"), (1, "cD"), (1, "Cd")], "doc_id long, value string")
    assert {r.value for r in assign.case_variants_out(df).collect()} == {"AB", "cD", "Cd"}


def test_smoothed_scores(spark):
    df = spark.createDataFrame([("a", 3, 4, 2), ("b", 0, 0, 0)], "category string, pred long, gold long, correct long")
    got = {r.category: (r.precision, r.recall, round(r.f1, 4)) for r in metrics.report(df).collect()}
    assert got == {"a": (0.5, 0.6, 0.5455), "b": (0.0, 1.0, 0.0)}


def test_overall_is_the_micro_sum(spark):
    df = spark.createDataFrame([("a", 3, 4, 2), ("b", 1, 1, 1)], "category string, pred long, gold long, correct long")
    got = {r.category: (r.pred, r.gold, r.correct) for r in metrics.with_overall(df).collect()}
    assert got["overall"] == (4, 5, 3)


def test_log_seconds_keep_all_digits(spark):
    line = "2020-04-27 14:45:33,101 - INFO - service - Time consumed: 12.081"
    assert spark.createDataFrame([(line,)], "value string").transform(metrics.log_seconds).first().seconds == 12.081


def test_rows_compare_with_the_previous_box(spark):
    rows = [(1, i, a, b) for i, (a, b) in enumerate([(0, 10), (2, 12), (11, 20), (13, 22), (30, 40)])]
    df = spark.createDataFrame(rows, "doc_id long, box_idx int, min_y double, avg_y double".replace("double", "int"))
    assert [r.row_id for r in layout.rows_by_previous(df).orderBy("box_idx").collect()] == [0, 0, 0, 0, 1]


def test_gap_of_thirty_at_font_ten(spark):
    rows = [(1, 0, 0, 0, 0.0, 50.0, 10.0), (1, 1, 0, 1, 80.0, 99.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, box_idx int, row_id long, row_pos int, x_start double, x_end double, height double")
    assert [r.n_blanks for r in layout.gaps(df).orderBy("box_idx").collect()] == [10, 0]


def test_unfinished_paragraph(spark):
    rows = [(1, 0, "a", 50.0, 10.0), (1, 1, "b", 100.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, row_id long, text string, x_end double, font double")
    assert layout.paragraphs_by_edge(df).count() == 1
    assert layout.paragraphs_by_edge(df, keep_tail=True).count() == 2


def test_few_boxes_are_strung_together(spark):
    rows = [(1, i, t, *[float(i)] * 8) for i, t in enumerate("ab")]
    df = spark.createDataFrame(rows, "doc_id long, box_idx int, text string, ax double, ay double, bx double, by double, cx double, cy double, dx double, dy double")
    assert layout.to_text(df).first().text == "a\nb\n"


def test_windows(spark):
    got = [col(spark, n, lambda v: arrays.window_starts(v, 10, 4), "int") for n in (0, 7, 10, 11, 23)]
    assert got == [[], [0], [0], [0, 4], [0, 4, 8, 12, 16]]


def test_softmax_and_best(spark):
    assert col(spark, [], arrays.softmax, "array<double>") == []
    assert np.allclose(col(spark, [1000.0, 1000.0], arrays.softmax, "array<double>"), [0.5, 0.5])
    assert abs(col(spark, [1000.0, 1000.0], arrays.log_sum_exp, "array<double>") - (1000 + np.log(2))) < 1e-9
    assert col(spark, [1.0, 3.0, 3.0, 2.0], lambda v: arrays.best_indexes(v, 3), "array<double>") == [1, 2, 3]


def test_flight_dates(spark):
    assert col(spark, "12 0CT", normalize.flight_date) == "12OCT"
    assert col(spark, "I2OCT19", normalize.flight_date) == "12OCT19"
    assert col(spark, "12OCT19", normalize.flight_date_iso) == "19-10-12"
    assert col(spark, "12OCT2019", normalize.flight_date_iso) == "2019-10-12"
    assert col(spark, "5 OCT.19", normalize.flight_date_iso) == "-19-10-5-"
    assert col(spark, "12OCT", normalize.flight_date_iso) == "10-12"
    assert col(spark, "12/10", normalize.flight_date_iso) == "12/10"
    assert col(spark, "ABC", normalize.flight_date) == ""


def test_record_dates(spark):
    assert col(spark, "2019.1.5", normalize.discharge_date) == "2019-01-05"
    assert col(spark, "2019年1月5日", normalize.discharge_date) == "2019年1月5日"
    assert col(spark, "2019年1月5日", lambda v: normalize.discharge_date(v, fixed=True)) == "2019-01-05"
    assert col(spark, "2019年1月5日", normalize.imaging_date) == "2019-01-05"
    assert col(spark, "5日", normalize.date_run) == ""
    assert col(spark, "入院2019年3月5日12时30分 次日", normalize.date_run) == "2019年3月5日12时30分"
    assert col(spark, "2019-03-05,10：20^x", normalize.date_run) == "2019-03-05,10：20^"


def on(spark, rows, expr):
    """``expr`` of value and text over pairs of them."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, t string")
    return [r.r for r in df.select("i", expr(F.col("v"), F.col("t")).alias("r")).orderBy("i").collect()]


def test_flight_numbers(spark):
    rows = [("CA1234", "东航 MU1234"), ("1234", "MU1234"), ("X1234", "南航CZ1234 东航MU1234"), ("航班1", ""), (None, "x"), ("5678", "海航 HU567")]
    assert on(spark, rows, normalize.flight_number) == ["MU1234", "1234", "MU1234", None, None, "5678"]


def test_numbers_and_names(spark):
    assert col(spark, "住院号:NK12-3 b", normalize.admission_number) == "NK12-3"
    assert col(spark, "WANG(A)", normalize.bracketless) == "WANG"
    amounts = {"12.0": True, "E-2.0": False, "1.O5": True, "合计1.0": False, "12.5": False, "o.5": True, "": False}
    assert {v: col(spark, v, normalize.is_amount_text) for v in amounts} == amounts
    known = ["zhang", "wang", "li", "a"]
    assert col(spark, "ZHANGLIA", normalize.syllables(known)) == ["zhang", "li", "a"]
    assert col(spark, "ZHANGXLI", normalize.syllables(known)) == ["zhang"]


def test_passenger_names(spark):
    known = ["zhang", "wang", "li", "ying", "hua", "a", "xiong", "qi", "feng"]
    rows = [
        ("XIONG/QIFENGSX", "NAME XIONG/QIFENGSX"),  # rest that spells nothing: the first syllable
        ("WANG/LIYINGHUA", "WANG/LIYINGHUA SEAT"),  # three syllables: two
        ("ANG/LI", "FROM ZHANG/LI TO"),  # letters cut off before the value come back
        ("WANG/LI", "WANG/LI MR 12"),  # the title after it
        ("WANG/LIM", "WANG/LIMR"),  # the letter after a final M
        ("WANG/LITL", "WANG/LITL"), ("TLWANG/LI", "TLWANG/LI"),  # letters that never follow one another
        ("WANG/LI登机", "WANG/LI登机口"), ("NAMEWANG/LI+", "NAMEWANG/LI+"), ("W", "W"), ("WANG/LI", "elsewhere"), (None, "x"), ("", "x"), ("WANG", None), ("WANG/", "WANG/"),
    ]
    want = ["XIONG/QI", "WANG/LIYING", "ZHANG/LI", "WANG/LI MR", "WANG/LIMR", "WANG/LI", "WANG/LI", "WANG/LI", "WANG/LI", None, "WANG/LI", None, "", "WANG", "WANG/"]
    assert on(spark, rows, normalize.passenger_name(known)) == want
    assert on(spark, [("ANG/LI", "ZHAANG/LI"), ("UAN/LI", "YUAN/LI")], normalize.passenger_name(known)) == ["ZHAANG/LI", "YUAN/LI"]


def test_final_values(spark):
    rows = [
        ("boardcards", "Name_PY", "WANG/LI+", "interface", ""), ("boardcards", "Name_PY", "WANG/LI登", "model", "WANG/LI登"), ("boardcards", "Origin_PY", "XIAMENXX", "model", ""),
        ("boardcards", "Origin_PY", "GATEXIAMEN", "model", ""), ("boardcards", "Destination_PY", "XIAM", "model", "to xiamen"), ("boardcards", "Destination_PY", "XIAM", "model", ""),
        ("boardcards", "Flight_Number", "12 34567", "model", "东航 mu123456"), ("boardcards", "Flight_Date", "I2 0CT", "model", ""), ("boardcards", "Name", "王", "model", ""), ("boardcards", "Origin", "厦门", "model", ""),
        ("xingchengdan", "Ticket_Fee", "CNY 12.0", "model", ""), ("xingchengdan_3code", "Name", "WANG/LI(A)", "model", "WANG/LI(A)"), ("xingchengdan_3code", "Name", "王", "model", ""),
        ("discharge_records", "Admission_Date", "于2019年1月5日", "model", ""), ("discharge_records", "Hospital_Name", "院", "model", ""), ("discharge_records", "Department", "骨料", "model", "骨料住院部"),
        ("imaging_report", "Check_Date", "于2019", "model", ""), ("boardcards", "Name", None, "model", ""), (None, "Name", "x", None, None),
    ]
    m = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "mention_id long, task string, category string, value string, pred_type string, text string")
    places = spark.createDataFrame([(1, "XIAMEN")], "list_pos int, value string")
    got = [r.final for r in values.final_values(m, places, ["wang", "li"]).orderBy("mention_id").collect()]
    assert got == [
        "WANG/LI", "WANG/LI", "XIAMEN", None, "XIAMEN", None, "MU123456", "12OCT", None, "厦门", " 12.0", "WANG/LI", "", "2019年1月5日", "", "骨科住院", "于2019", None, "x",
    ]


def test_departments(spark):
    rows = [("骨料(东", "入骨料(东)区"), ("骨科", "骨科住院号"), ("骨科", "骨科住院部"), ("儿科", "儿科"), ("骨科(东", "骨科(东）住院"), ("外科", "内科"), (None, "x"), ("外科", None)]
    assert on(spark, rows, normalize.department) == ["骨科(东)", "骨科", "骨科住院", "儿科", "骨科(东)", "外科", None, "外科"]


def boxes(spark, rows):
    """``(doc, text, x)`` as boxes of one row each."""
    data = [(d, i, t, x, 0.0, x + 5, 0.0, x + 5, 9.0, x, 9.0) for i, (d, t, x) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id int, box_idx int, text string, ax double, ay double, bx double, by double, cx double, cy double, dx double, dy double")


def test_columns_by_header(spark):
    heads = spark.createDataFrame([(1, 10.0, 20.0, 40.0)], "doc_id int, left_x double, mid_x double, right_x double")
    b = boxes(spark, [(1, str(x), float(x)) for x in (5, 10, 15, 20, 29, 30, 31, 40, 41)])
    got = {r.text: r.column_name for r in layout.columns_by_header(b, heads).collect()}
    assert got == {"5": "before", "10": "at_mid", "15": "between", "20": "at_mid", "29": "at_mid", "30": "rest", "31": "rest", "40": "rest", "41": "beyond"}


def test_fees(spark):
    heads = [("民航发展", 10.0), ("燃油附加", 20.0), ("合计", 40.0)]
    rows = [(1, *h) for h in heads] + [(1, "CNY 9.0", 5.0), (1, "1.0", 15.0), (1, "2.0", 21.0), (1, "3.0", 39.0), (1, "40.0", 50.0), (1, "七.0", 1.0), (1, None, 2.0)]
    rows += [(2, *h) for h in heads] + [(2, "9.0", 5.0), (2, "2.0", 21.0), (2, "3.O", 39.0), (2, "4.0", 50.0)]
    rows += [(3, *h) for h in heads[:2]] + [(3, "9.0", 5.0)]
    rows += [(4, "燃油附加费", 1.0), *[(4, *h) for h in heads], (4, "6.0", 15.0)]  # the last box with a header's words counts
    got = {(r.doc_id, r.category, r.value) for r in layout.fees(boxes(spark, rows)).collect()}
    five = {(1, c, v) for c, v in zip(layout.FEES, ("9.0", "1.0", "2.0", "3.0", "40.0"))}
    assert got == five | {(2, "Ticket_Fee", "9.0"), (2, "Oil_Fee", "2.0"), (2, "Other_Fee", "3."), (2, "Total_Fee", "4.0"), (4, "Develop_Fee", "6.0")}


def test_canonical_text(spark):
    assert col(spark, "a b\n　c\t", text.canonical) == "abmjwemptymjwc"
    assert col(spark, "aMJWEMPTYMJWb", text.restored) == "a\nb"
    assert col(spark, "a mjwemptyMJWb", text.char_tokens) == ["a", "mjwemptyMJW", "b"]
    assert col(spark, "Hi,世界", text.basic_tokens) == ["hi", ",", "世", "界"]
    assert col(spark, "Café", text.strip_accents) == "Cafe"


def test_word_pieces(spark):
    split = text.pieces({"un", "##able", "a"})
    assert col(spark, ["unable", "xyz", "a"], split, "array<string>") == ["un", "##able", "[UNK]", "a"]


def test_basic_tokens_in_full(spark):
    assert col(spark, "Ab\u200bC\u0000 Élan, 世界x℃y—z $5\u3000ﬁn\ufffd", text.basic_tokens) == ["abc", "elan", ",", "世", "界", "x℃y", "—", "z", "$", "5", "ﬁn"]
    assert col(spark, "Ab Élan", lambda v: text.basic_tokens(v, lower=False)) == ["Ab", "Élan"]
    assert col(spark, None, text.basic_tokens) is None and col(spark, "", text.basic_tokens) == []
    vocabulary = text.vocabulary_of("[UNK]\nun\n##able\na\n世\n")
    assert vocabulary == ["[UNK]", "un", "##able", "a", "世"]
    assert col(spark, "Unable 世b a", lambda v: text.full_tokens(v, vocabulary)) == ["un", "##able", "世", "[UNK]", "a"]
    assert col(spark, ["a", "zz"], text.ids_of(vocabulary, "[UNK]"), "array<string>") == [3, 0]
    assert col(spark, [3, 1], lambda v: text.tokens_of(v, vocabulary), "array<int>") == ["a", "un"]
    assert col(spark, [0, 299], lambda v: text.tokens_of(v, [f"t{i}" for i in range(300)]), "array<int>") == ["t0", "t299"]


def test_first_of_many_patterns(spark):
    codes = [f"C{i}X" for i in range(2000)]
    patterns = [*text.code_patterns(codes, [("", "[0-9]"), ("to ", "")]), "[0-9]{3}"]
    df = spark.createDataFrame([(0, "c7x5 to C3X"), (1, "to C1999X"), (2, "only 123"), (3, "C5X"), (4, None), (5, "")], "k int, t string")

    def found(**kw):
        return [(r.f.pattern_pos, r.f.match) for r in df.select("k", text.first_of_many(patterns, **kw)("t").alias("f")).orderBy("k").collect()]

    assert found() == [(7, "to C3X"), (3999, "to C1999X"), (4000, "123"), (None, None), (None, None), (None, None)]
    assert found(ignore_case=True)[0] == (7, "to C3X") and text.first_of_many([]) is not None


def test_cleaned_values(spark):
    rows = [(1, "Ab"), (1, "AB"), (1, "xabz。"), (1, "x"), (1, "q“q"), (1, "seen"), (2, "AB"), (2, None), (1, "世界和平"), (1, "世界"), (3, "cD"), (3, "Cd")]
    v = spark.createDataFrame(rows, "doc_id long, value string")
    seen = spark.createDataFrame([("seen",)], "value string")
    got = {(r.doc_id, r.value) for r in assign.cleaned_values(v, seen).collect()}
    assert got == {(1, "xabz"), (2, "AB"), (1, "世界和平")}


def test_averages(spark):
    c = spark.createDataFrame([("a", 4, 2, 1), ("b", 0, 2, 0)], "category string, pred long, gold long, correct long")
    got = {r.category: (r.precision, r.recall, round(r.f1, 4), r.support) for r in metrics.averages(c).collect()}
    assert got == {"a": (0.25, 0.5, 0.3333, 2), "b": (0.0, 0.0, 0.0, 2), "micro avg": (0.25, 0.25, 0.25, 4), "macro avg": (0.125, 0.25, 0.1667, 4)}
    pred = spark.createDataFrame([(1, "n", "x"), (1, "n", "x"), (1, "n", "z")], "doc_id int, category string, value string")
    gold = spark.createDataFrame([(1, "n", "x"), (1, "n", "y")], "doc_id int, category string, value string")
    r = metrics.counts(pred, gold, to_set=False, each=True).first()
    assert (r.pred, r.gold, r.correct) == (3, 2, 2)
    losses = spark.createDataFrame([(1.0, 2), (None, 5), (3.0, 2)], "l double, n long")
    assert metrics.mean_loss(losses, "l").first().mean_loss == 2.0 and metrics.mean_loss(losses, "l", "n").first().mean_loss == 1.0


def test_masked_sequences_against_brute_force(spark):
    from itertools import product

    rng = np.random.default_rng(5)
    e, t = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    body = e[1:4]  # behind the mark of beginning, before the padding
    score = lambda p: sum(body[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
    paths = list(product(range(3), repeat=3))
    df = spark.createDataFrame([(e.tolist(), [-100, 2, -100, 1, 0, 0], 4), (e.tolist(), [0] * 6, 1), (None, None, None)], "e array<array<double>>, y array<int>, n int")
    got = df.select(scoring.masked_viterbi(t)("e", "n").alias("p"), scoring.masked_loss(t)("e", "y", "n").alias("l")).collect()
    assert got[0].p == list(max(paths, key=score)) and got[1].p == got[2].p == []
    assert abs(got[0].l - (np.log(sum(np.exp(score(p)) for p in paths)) - score((2, 0, 1)))) < 1e-9 and got[1].l == got[2].l == 0


def test_question_targets(spark):
    q = F.array(*map(F.lit, "abc"))
    rows = [(0, 10, 2, 4, True), (5, 10, 2, 4, True), (5, 10, 6, 15, True), (5, 10, 6, 14, True), (0, 10, 0, -1, False)]
    df = spark.createDataFrame(rows, "start int, size int, a int, b int, known boolean")
    got = [r.t for r in df.select(datasets.question_targets(q, *map(F.col, ("start", "size", "a", "b", "known"))).alias("t")).collect()]
    assert [g and tuple(g) for g in got] == [(7, 9, 0), None, None, (6, 14, 0), (2, 5, 1)]
    f = datasets.features(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(7), F.lit(8), F.lit(9)), 5, marks=3)
    assert spark.range(1).select(f["input_ids"].alias("i")).first().i == [101, 1, 2, 102, 102]
    names = spark.createDataFrame([("p10.txt",), ("p9.txt",), ("x",), ("p9b.txt",)], "name string")
    assert [r.name for r in datasets.numbered(names, "name").collect()] == ["p9.txt", "p9b.txt", "p10.txt", "x"] and datasets.numbered(names, "name", 2).count() == 2


def test_first_pattern_in_list_order(spark):
    df = spark.createDataFrame([(1, "x 22 CA11"), (2, "none")], "k int, t string")
    got = text.first_pattern(df, "k", "t", ["CA[0-9]+", "[0-9]+"]).collect()
    assert [(r.k, r.pattern_pos, r.match, r.rest) for r in got] == [(1, 0, "CA11", "x 22  ")]


def test_containment_ratio(spark):
    e = spark.createDataFrame([(5, "XIAMEN"), (7, "MENG"), (9, "XIANYANG")], "list_pos int, value string")
    rows = [("XIAMENXX", ""), ("XIA", "XIAMEN"), ("XIAM", "XIAMEN"), ("XIAM", "elsewhere"), ("MENG", ""), (None, ""), ("GATE XIAMEN", ""), ("XIAN", "TO XIANYANG"), ("XIAMENXXXXXX", "XIAMEN")]
    v = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, value string, text string")
    assert {r.id: r.entry for r in match.containment_ratio(v, e, "id").collect()} == {0: "XIAMEN", 2: "XIAMEN", 4: "MENG", 7: "XIANYANG"}


def test_overlap_prefers_later_of_equal(spark):
    q = spark.createDataFrame([(1, ["a", "b"])], "query_id long, tokens array<string>")
    d = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["a", "b", "b"]), (4, ["z"])], "entry_pos long, tokens array<string>")
    assert [(r.entry_pos, r.overlap) for r in match.overlap_top(q, d, 2).orderBy("rank").collect()] == [(3, 2), (2, 1)]


def test_cosine_top_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<float>")
    got = match.cosine_top(df.where("vec_id % 20 = 0"), df, k=5, block=2).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -9
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == list(np.argsort(-s)[:5])


def test_votes(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (2, 1)], "qas_id long, no_answer long")
    assert {r.qas_id: r.answered for r in spans.vote(df).collect()} == {1: True, 2: False}


def test_tightest_span(spark):
    df = spark.createDataFrame([(["a", "b", "c", "b"], ["b"]), (["a"], ["z"])], "t array<string>, w array<string>")
    got = [r[0] for r in df.select(spans.tightest(F.col("t"), F.col("w"), F.lit(0), F.size("t") - 1)).collect()]
    assert [(g.start, g.end) for g in got] == [(1, 1), (0, 0)]


def test_original_text(spark):
    df = spark.createDataFrame([("helloworld", "Say Hello World!"), ("zzz", "abc")], "p string, t string")
    assert [r[0] for r in df.select(spans.original_text()("p", "t")).collect()] == ["Hello World", "abc"]


def test_envelope_codes(spark):
    rows = [(1, None, None), (2, "", "fail"), (3, "", "success"), (4, "boom", "success")]
    df = spark.createDataFrame(rows, "raw_id long, error string, message string")
    assert [r.code for r in envelope.coded(df).orderBy("raw_id").collect()] == ["10002", "10006", "200", "10006"]


def test_features(spark):
    f = datasets.features(F.col("i"), F.col("l"), 6)
    r = spark.createDataFrame([([1, 2], [7, 8])], "i array<int>, l array<int>").select(*[v.alias(k) for k, v in f.items()]).first()
    assert (r.input_ids, r.input_mask, r.label_ids, r.input_len) == ([101, 1, 2, 102, 0, 0], [1, 1, 1, 1, 0, 0], [-100, 7, 8, -100, -100, -100], 4)


def test_viterbi_against_brute_force(spark):
    from itertools import product

    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    best = max(product(range(3), repeat=4), key=lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])))
    assert col(spark, e.tolist(), scoring.viterbi(t), "array<array<double>>") == list(best)


def test_splits_are_stable(spark):
    a = datasets.split(spark.range(1000), "id").repartition(7).groupBy("split").count().collect()
    b = datasets.split(spark.range(1000), "id").coalesce(1).groupBy("split").count().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 3


def test_helpers(spark):
    df = spark.range(10).coalesce(1)
    assert spread(df).count() == 10 and cut_lineage(df).count() == 10


def test_batches_and_medians_in_hot_groups(spark):
    df = spark.range(1000).select((F.col("id") * 37).alias("i"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 900, "x").alias("g"))
    got = datasets.batches(df, "g", "i", 32, span=500).collect()
    for g in ("hot", "x", None):
        own = sorted((r.i, r.batch) for r in got if r.g == g)
        assert [b for _, b in own] == [k // 32 for k in range(len(own))]
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("a", 1001), ("b", 10), ("c", 1)) for v in np.round(rng.normal(size=n), 2)] + [("d", 2.0)] * 5 + [("e", None), (None, 1.0)]
    m = {r.k: r.median for r in metrics.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v", bins=16).collect()}
    want = {k: float(np.median([v for x, v in rows if x == k])) for k in "abcd"}
    assert {k: round(v, 9) for k, v in m.items()} == {k: round(v, 9) for k, v in want.items()}


def test_sequence_loss_against_brute_force(spark):
    from itertools import product

    rng = np.random.default_rng(4)
    e, t = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    score = lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
    want = np.log(sum(np.exp(score(p)) for p in product(range(2), repeat=3))) - score((0, 1, 1))
    df = spark.createDataFrame([(e.tolist(), [0, 1, 1]), ([], [])], "e array<array<double>>, y array<int>")
    got = [r[0] for r in df.select(scoring.sequence_loss(t)("e", "y")).collect()]
    assert abs(got[0] - want) < 1e-9 and got[1] == 0


def test_inherited_settings():
    files = {"a": {"inherit": {"path": "b"}, "int_x": {"n": "3"}}, "b": {"int_x": {"n": "1", "m": "2"}, "bool_x": {"on": "True"}, "str_x": {"s": "t"}}}
    assert datasets.inherited(files, "a") == {"n": 3, "m": 2, "on": True, "s": "t"}
