"""Problems 2 and 3."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import mapping, privacy


def kinds(text, name=False):
    return [(text[a:b], k) for a, b, k in privacy.items_of_value(text, name)]


def test_emails():
    assert kinds("E-mail:li.wei_7@mail.example.org,") == [("li.wei_7@mail.example.org", "email")]
    assert kinds("mailwei@x.test。") == [("wei@x.test", "email")]
    assert kinds("(wei(at)example dot com)") == [("wei(at)example dot com", "email")]
    assert kinds("邮箱:wei[at]maildotexampledotorg;") == [("wei[at]maildotexampledotorg", "email")]
    assert kinds("条码@12489961911") == []


def test_phones():
    for p in ("13800138000", "138-0013-8000", "138.0013-8000", "+86 13800138000", "008613800138000", "0571-88888888", "010—66666666转12", "02166666666"):
        assert kinds(f"电话:{p},好") == [(p, "phone")], p
    assert kinds("流水号13800138000") == [] and kinds("票号12345678901") == [] and kinds("住院号00815892-3") == []


def test_identity_numbers():
    assert kinds("证号为119983194609220085;") == [("119983194609220085", "id_number")]
    assert kinds("持证11998319460922008X") == [("11998319460922008X", "id_number")]
    assert kinds("339972601018003") == [("339972601018003", "id_number")]
    assert kinds("419971 19731101 7338") == [("419971 19731101 7338", "id_number")]
    assert kinds("ID G30932122") == [("G30932122", "id_number")]
    assert kinds("201953778885046148") == [] and kinds("住院号B5311806") == []


def test_addresses():
    assert kinds("寄至江右西省骊泊市扶桑巷311号,")[0][0] == "江右西省骊泊市扶桑巷311号"
    assert kinds("住址:汐壑区丰登乡问渠村10组4号。")[0][0].startswith("汐壑区丰登乡")
    assert kinds("现住No.33TongwanLane,Pingzhai")[0] == ("No.33TongwanLane,Pingzhai", "address")
    assert kinds("就诊于雾矶市第二人民医院") == []


def test_names():
    assert kinds("联系人马槿骁、廖渊") == [("马槿骁", "person_name"), ("廖渊", "person_name")]
    assert kinds("患者艾克峤·买尔皓未随行") == [("艾克峤·买尔皓", "person_name")]
    assert kinds("审核:René Marín。") == [("René Marín", "person_name")]
    assert kinds("NAMEZHOU/ZANGMR") == [("ZHOU/ZANGMR", "person_name")]
    assert kinds("HUAI GAO MS", True) == [("HUAI GAO MS", "person_name")]
    assert kinds("朱 筠芷", True) == [("朱 筠芷", "person_name")]
    assert [k for _, k in kinds("陆蔚 霁泉县石桥街764号", True)] == ["person_name", "address"]
    for filler in ("见腕带", "姓名", "***", "—", "NAME", "无名氏"):
        assert kinds(filler, True) == []


def test_names_and_numbers_in_general():
    for t, name in {"患者王小明": "王小明", "患者王小明今日入院": "王小明", "姓名:赵铁柱 性别:男": "赵铁柱", "Name: John Smith": "John Smith", "Seen by Mr John Smith today": "John Smith"}.items():
        assert kinds(t) == [(name, "person_name")], t
    assert kinds("张三和李四") == [("张三", "person_name"), ("李四", "person_name")] and kinds("John Smith", True) == [("John Smith", "person_name")]
    assert kinds("患者左下肢今日肿胀") == [] and kinds("热敷和冷敷") == [] and kinds("Hospital Road") == []
    for p in ("415-555-0132", "(415) 555-0132", "+44 20 7946 0958", "+1 415.555.0132"):
        assert kinds(f"call {p}, please") == [(p, "phone")], p
    assert kinds("81.4mm*58.5mm 2019-03-05 10:20 12345-678-90") == []


def test_digit_anchors_find_what_a_whole_search_finds():
    """Parsers that start at digit anchors match where a search over all positions does."""
    import random

    rng = random.Random(11)
    for _ in range(2000):
        t = "".join(rng.choices("0123456789AZaz +(-. 号", weights=[6] * 10 + [2] * 4 + [3] * 7, k=60))
        digits = privacy.anchors_of(t).get("digit", [])
        for pattern, before in ((privacy._digits, "+("), (privacy._passport, "A"), (privacy._passport_low, "A"), (privacy._id_after_letters, "")):
            assert [m.span() for m in privacy.expanded(pattern, t, digits, before)] == [m.span() for m in pattern.finditer(t)]


def test_positions_in_words_and_redaction(spark):
    words = ["患", "者", None, "马", "", "槿", "骁", "，", "电", "话", "１３８", "00138000", "。"]
    assert privacy.items_of_words(words) == [(3, 7, "person_name"), (10, 12, "phone")]
    df = spark.createDataFrame([(1, words), (2, None), (3, []), (4, ["x"] * 20_000)], "example_id long, words array<string>").withColumn("kind", F.lit("clash"))
    assert {(r.row_id, r.kind, r.start) for r in privacy.find_in_words(df, "example_id").collect()} == {(1, "person_name", 3), (1, "phone", 10)}
    out = {r.example_id: r.words for r in privacy.redact_words(df).collect()}
    assert out[1] == ["患", "者", None, "[PERSON_NAME]", "，", "电", "话", "[PHONE]", "。"] and out[2] is None and out[3] == [] and len(out[4]) == 20_000
    v = spark.createDataFrame([(1, "姓名 沈绮 13800138000"), (2, None), (3, "")], "mention_id long, value string")
    assert [r.value for r in privacy.redact_values(v, "value", F.lit(True)).orderBy("mention_id").collect()] == ["姓名 [PERSON_NAME] [PHONE]", None, ""]
    assert privacy.find_in_values(v.limit(0), "mention_id", "value", F.lit(True)).count() == 0


HOSPITALS = ["澄礁市人民医院", "澄礁市第一人民医院", "澄礁市第二人民医院", "雾矶市中医医院", "雾矶市肿瘤医院", "鹭堡县骨伤专科医院", "鹭堡县妇幼保健院"]
MEANT = {
    "就诊医院:澄礁市人民医院": 0, "云江省澄礁市第一人民医院骨科": 1, "澄礁市一院": 1, "澄礁第二医院": 2, "澄礁人医": 0, "澄礁市八民医院": 0, "澄礁市弟二入氏匡院": 2,
    "澄礁市第二二人民医院": 2, "霧磯市中醫醫院": 3, "雾*市肿瘤医院": 4, "雾矶市肺瘤医": 4, "雾 矶 市 中 医 院": 3, "鹭堡骨伤医院": 5, "鹭堡县妇幼保健": 6, "鹭​堡县妇保院": 6,
    "澄礁市第六人民医院": -1, "澄清市人民医院": -1, "雾矶市精神卫生中心": -1, "雾矶市人民医院": -1, "澄礁县人民医院": -1, "": -1, "出院记录": -1,
}
PLACES = ["SANKUAN", "YUANLING", "KONGDANZHU", "MINBAN"]
PLACE_MEANT = {"FROM SANKUAN": 0, "sankuan": 0, "ＳＡＮＫＵＡＮ": 0, "SANKVAN": 0, "SANKUAN(T1)": 0, "YUANLING INTL": 1, "KO-NGDANZHU": 2, "KONGDAN": 2, "MIBNAN": 3, "GATE": -1, "YUANGAO": -1}


def mapped(spark, name, values, entries, **kw):
    ref = spark.createDataFrame([(i, e, "x") for i, e in enumerate(entries)], "list_pos int, value string, extra string")
    v = spark.createDataFrame([(x, i) for i, x in enumerate([*values, None, *values])], "value string, list_pos int")
    return {r.value: r.list_pos for r in mapping.map_values(v, "value", ref, name, **kw).collect()}


def test_hospitals(spark):
    assert mapped(spark, "hospital", MEANT, HOSPITALS) == MEANT


def test_places(spark):
    assert mapped(spark, "place_py", PLACE_MEANT, PLACES) == PLACE_MEANT


def test_entries_without_a_known_form_go_by_cosine(spark):
    """Cosine, its lead and equal numbers decide where the list shows no towns and kinds."""
    entries = ["北京协和医院", "上海瑞金医院", "四川大学华西医院", "海军第三疗养院", "海军第四疗养院"]
    want = {"北京协合医院": 0, "上海市瑞金医院": 1, "四川大学华西医院": 2, "华西医院": 2, "海军第三疗养院": 3, "海军疗养院": -1, "海军第五疗养院": -1, "北京第二医院": -1, "广州中山医院": -1}
    assert mapped(spark, "hospital", want, entries) == want
    assert mapped(spark, "place_py", ["GUANZOU", "HANGZOHU", "NINGBO"], ["GUANGZHOU", "HANGZHOU", "XIAMEN"]) == {"GUANZOU": 0, "HANGZOHU": 1, "NINGBO": -1}


def test_long_lists_go_in_blocks(spark):
    assert mapped(spark, "hospital", MEANT, HOSPITALS, block=3) == MEANT


def test_mapping_edges(spark):
    assert set(mapped(spark, "hospital", ["澄礁市人民医院", "x" * 20_000], []).values()) == {-1}
    empty = spark.createDataFrame([], "value string")
    ref = spark.createDataFrame([(1, "澄礁市人民医院")], "list_pos int, value string")
    assert mapping.map_values(empty, "value", ref, "hospital").count() == 0


def test_prefix_filter_loses_nothing(spark):
    """Candidates of the filtered retrieval are those of a full scan."""
    ix = mapping.Index(list(enumerate(HOSPITALS)), mapping.normalize_han, 2, mapping.HospitalCheck, 0.2, 0.02)
    full = mapping.Index(list(enumerate(HOSPITALS)), mapping.normalize_han, 2, mapping.HospitalCheck, 0.0, 0.02)
    for v in MEANT:
        s = mapping.normalize_han(v)
        want = sorted(i for c, i in full.candidates(s) if c >= 0.2) if s else []
        assert sorted(i for _, i in ix.candidates(s)) == want


def test_too_many_places_raise(spark, monkeypatch):
    monkeypatch.setattr(privacy, "MOST_PLACES", 2)
    places = spark.createDataFrame([("Paris",), ("Rome",), ("Rome",), (None,)], "value string")
    assert {"PARIS", "ROME"} <= privacy.known_places(places) and privacy.known_places(None) == frozenset()
    with pytest.raises(ValueError, match="more than 2 place names"):
        privacy.known_places(places.union(spark.createDataFrame([("Oslo",)], "value string")))
