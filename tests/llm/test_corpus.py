"""Problems 5, 7, 8 and 9."""

import random

import pandas as pd
from pyspark.sql import functions as F

from docloom.llm import leakage, overlap, packing, spam


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_bounded_distance():
    rng = random.Random(0)
    for _ in range(300):
        a = "".join(rng.choices("abc", k=rng.randint(0, 20)))
        b = "".join(rng.choices("abc", k=rng.randint(0, 20)))
        d, k = levenshtein(a, b), rng.randint(0, 8)
        assert overlap.within(a, b, k) == (d if d <= k else k + 1)


def test_overlaps_equal_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/examples.parquet")
    got = {(r.example_train, r.example_eval) for r in overlap.overlaps(df).collect()}
    rows = [(r.example_id, r.split, r.text) for r in overlap.labelled_texts(df).collect()]
    want = set()
    for i, s, a in rows:
        for j, t, b in rows:
            if s == "train" and t != "train":
                k = max(len(a), len(b)) // 5
                if overlap.within(a, b, k) <= k:
                    want.add((i, j))
    assert got == want


def changed(text, share, rng):
    out = list(text)
    for _ in range(int(len(text) * share)):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice(([], ["变"], [out[i], "加"]))
    return "".join(out)


def test_noisy_copies_are_found(spark):
    rng = random.Random(1)
    alphabet = [chr(0x4E00 + i) for i in range(800)]
    rows, want = [], set()
    for n in range(60):
        text = "".join(rng.choices(alphabet, k=rng.choice((12, 30, 80, 200, 600))))
        copy = changed(text, 0.15, rng)
        rows += [(2 * n, "a/train.txt", list(text)), (2 * n + 1, "a/dev.txt", list(copy))]
        if levenshtein(text, copy) * 5 <= max(len(text), len(copy)):
            want.add((2 * n, 2 * n + 1))
    df = spark.createDataFrame(rows, "example_id long, path string, words array<string>").withColumns({"guid": F.lit(None).cast("string"), "source": F.lit("s")})
    assert {(r.example_train, r.example_eval) for r in overlap.overlaps(df).collect()} == want and len(want) > 40


def test_copies_at_the_limit_are_found(spark):
    """Copies of templated texts with a fifth of errors, spread evenly, are all found at any length."""
    rng = random.Random(3)
    alphabet = [chr(0x4E00 + i) for i in range(800)]
    phrases = ["".join(rng.choices(alphabet, k=12)) for _ in range(30)]
    rows, want = [], set()
    for n in range(150):
        text = ""
        while len(text) < (30, 60, 110, 150, 190, 400)[n % 6]:
            text += rng.choice(phrases) + "".join(rng.choices(alphabet, k=3))
        copy, k = list(text), len(text) // 5 - n % 2
        for i in rng.sample(range(len(text)), k):
            copy[i] = "变"
        rows += [(2 * n, "a/train.txt", list(text)), (2 * n + 1, "a/dev.txt", copy)]
        want.add((2 * n, 2 * n + 1, k))
    df = spark.createDataFrame(rows, "example_id long, path string, words array<string>").withColumns({"guid": F.lit(None).cast("string"), "source": F.lit("s")})
    assert {(r.example_train, r.example_eval, r.distance) for r in overlap.overlaps(df).collect()} == want


def test_segments_and_counts_lose_no_pair(spark, monkeypatch):
    """Every pair within a fifth has a segment in common where it may stand, and
    passes the counts; blocks that are split lose none."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("甲乙丙丁戊己庚辛壬癸子丑寅卯", k=rng.randint(12, 90))) for _ in range(80)]
    copies = [changed(t, 0.16, rng) for t in texts]
    a, b = overlap.Block(pd.Series(copies)), overlap.Block(pd.Series(texts))
    near = {(i, j) for i, x in enumerate(copies) for j, y in enumerate(texts) if levenshtein(x, y) * 5 <= max(len(x), len(y))}
    i, j = overlap.candidates(a, b, 5)
    assert near <= set(zip(i.tolist(), j.tolist())) and len(near) > 50 and len(i) < 80 * 80
    i, j = overlap.unlike(a, b, i, j, 5)
    assert near <= set(zip(i.tolist(), j.tolist()))
    monkeypatch.setattr(overlap, "EVAL_BLOCK", 7)
    monkeypatch.setattr(overlap, "TRAIN_BLOCK", 5)
    rows = [(i, "a/train.txt", list(t)) for i, t in enumerate(texts)] + [(100 + i, "a/dev.txt", list(t)) for i, t in enumerate(copies)]
    df = spark.createDataFrame(rows, "example_id long, path string, words array<string>").withColumns({"guid": F.lit(None).cast("string"), "source": F.lit("s")})
    assert {(r.example_eval - 100, r.example_train) for r in overlap.overlaps(df).collect()} == near


def test_evenly_spread_changes_are_found():
    """19 % of changes, evenly, at 60 to 600 characters."""
    rng = random.Random(9)
    texts = ["".join(chr(0x4E00 + rng.randrange(400)) for _ in range(n)) for n in (60, 90, 150, 300, 600) for _ in range(20)]
    copies = ["".join("变" if i * 19 % 100 >= 81 else c for i, c in enumerate(t)) for t in texts]
    a, b = overlap.Block(pd.Series(copies)), overlap.Block(pd.Series(texts))
    i, j = overlap.unlike(a, b, *overlap.candidates(a, b, 5), 5)
    assert {(k, k) for k in range(100)} <= set(zip(i.tolist(), j.tolist()))


def test_no_broadcast_of_texts(spark, data):
    """Only the pairs of length classes are broadcast."""
    plan = overlap.overlaps(spark.read.parquet(f"{data}/examples.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2 and "e_rep" not in "".join(x for x in plan.split("\n") if "BroadcastExchange" in x)


def test_overlap_edges(spark):
    w = list("一二三四五六七八九十")
    rows = [
        (1, "train-1", "t/train.txt", w), (2, "test-2", "t/test.txt", [*w, None, "", " "]), (3, "dev-3", None, w), (4, None, None, w), (5, "x", "t/test.txt", None),
        (6, "x", "t/dev.txt", w[:9]), (7, "x", "t/train.txt", w), (8, "x", "t/train.txt", []), (9, "x", "t/dev.txt", [c + "​" for c in w]), (10, "x", "t/dev.txt", list("ａｂｃｄｅｆｇｈｉｊ")), (11, "x", "t/train.txt", list("ABCDEFGHIJ")),
    ]
    df = spark.createDataFrame(rows, "example_id long, guid string, path string, words array<string>").withColumns({"source": F.lit(None).cast("string"), "text": F.lit("clash"), "split": F.lit("clash")})
    got = {(r.example_train, r.example_eval, r.distance) for r in overlap.overlaps(df).collect()}
    assert got == {(a, b, 0) for a in (1, 7) for b in (2, 3, 9)} | {(11, 10, 0)}
    assert overlap.overlaps(df.limit(0)).count() == 0


def bins_of(lengths, placed):
    bins = {}
    for n, (b, slot, c) in zip(lengths, placed):
        bins.setdefault(b, []).append((n, slot, c))
    return bins


def test_packing_bins():
    rng = random.Random(2)
    lengths = [min(2048, int(rng.paretovariate(0.8) * 60)) for _ in range(5000)]
    placed = packing.pack_lengths(lengths, 2048)
    bins = bins_of(lengths, placed)
    assert max(sum(n for n, _, _ in b) for b in bins.values()) <= 2048 and len(set(placed)) == len(lengths)
    assert len(bins) <= 1.02 * sum(lengths) / 2048 + 1
    assert packing.pack_lengths([], 10) == [] and packing.pack_lengths([10, 10], 10) == [(0, 0, 1), (1, 0, 1)]
    assert packing.pack_lengths([1] * 25, 10, classes=4) == [(b, s, 4) for b in (0, 1) for s in range(10)] + [(2, s, 4) for s in range(5)]


def test_packing_by_class():
    """Bins hold their class's fixed number of its items; pure ones nothing else."""
    rng = random.Random(3)
    lengths = [rng.randint(1, 1000) for _ in range(3000)]
    for top_up in (False, True):
        last = {}
        for k, b in sorted(bins_of(lengths, packing.pack_lengths(lengths, 1000, 20, top_up)).items()):
            (c,) = {x for _, _, x in b}
            own = [n for n, _, _ in b if packing.size_class(n, 1000, 20) == c]
            assert top_up or len(own) == len(b)
            assert all(packing.size_class(n, 1000, 20) >= c for n, _, _ in b) and sum(n for n, _, _ in b) <= 1000
            assert sorted(s for _, s, _ in b) == list(range(len(b)))
            if c < 20:
                assert last.get(c, c) == c  # only the last bin of a class may hold fewer
                last[c] = len(own)
                assert len(own) <= c


def test_packing_keeps_every_document(spark):
    texts = ["", None, "短", "word " * 5000, "same", "same", "  "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bin_id string")
    counted = packing.count_tokens(df)
    packed = packing.pack(counted, capacity=512, shard_items=2)
    rows = packed.collect()
    n = {r.doc_id: r.n_tokens for r in counted.collect()}
    assert set(n) == set(range(7)) and n[0] == n[1] == 0
    for i in n:
        parts = sorted((r.start_token, r.n_tokens) for r in rows if r.doc_id == i)
        assert sum(p[1] for p in parts) == n[i] and (n[i] > 512 or len(parts) == 1)
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
    fill = {}
    for r in rows:
        if r.bin_id is not None:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
    assert max(fill.values()) <= 512 and {r.doc_id for r in rows if r.bin_id is None} == {0, 1}
    enc = packing.encoding(packing.VOCABULARY)
    seqs = packing.packed_sequences(df, packed).collect()
    assert sorted(t for s in seqs for t in s.tokens) == sorted(t for x in texts if x for t in enc.encode_ordinary(x))
    assert packing.pack(packing.count_tokens(df.limit(0))).count() == 0


PASSAGE = "患者于清晨在湿滑路面跌倒致右侧髌骨骨折,入院后完善检查,行闭合复位石膏外固定,术后逐步拄拐行走并按时服药。两周后门诊复查提示骨痂形成良好,膝关节活动度基本恢复,嘱继续加强股四头肌锻炼。"


def leaks(spark, texts, contexts=(PASSAGE,), **kw):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(n, c, 0) for n, c in enumerate(contexts)], "item_id long, context string, doc_id int")
    return {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i, **kw).collect()}


def test_leaks(spark):
    half = len(PASSAGE) // 2
    wide = "".join(chr(ord(c) + 0xFEE0) if c == "," else c for c in " ".join(PASSAGE))
    typo = "".join("口" if i % 17 == 9 else c for i, c in enumerate(PASSAGE))
    texts = [
        PASSAGE, "前文。" + PASSAGE[: half + 6] + "后文。", PASSAGE[:30] + "。完全不同的另一段话在这里插入进来。" + PASSAGE[40:70], wide, typo,  # leaks
        PASSAGE[:30], PASSAGE[60:90] + "。另一段话。" + PASSAGE[:30], "术后逐步拄拐行走并按时服药。", "", None, "无关" * 5000,  # none
    ]
    assert leaks(spark, texts) == {(i, 0) for i in range(5)}


def test_noisy_half_copies_leak(spark):
    """Half copies with wrong letters up to the budget are found, in English as well."""
    rng = random.Random(6)
    words = "insured scar landing itinerary desk amended reviewing shortly healed surgical person forwarded delayed branch office fog connection because dense note translated".split()
    english = [" ".join(rng.choices(words, k=70)) for _ in range(20)]
    chinese = ["".join(chr(0x4E00 + rng.randrange(600)) for _ in range(120)) for _ in range(20)]
    passages, texts = english + chinese, []
    for p in map(leakage.letters, passages):
        copy = list(p[: int(len(p) * 0.6)])
        for i in rng.sample(range(8, len(copy) - 8), len(copy) * 9 // 100):
            copy[i] = "q"
        texts.append("开头。" + "".join(copy) + "。结尾")
    assert {(i, i) for i in range(40)} <= leaks(spark, texts, passages)
    others = [" ".join(rng.choices(words, k=70)) for _ in range(20)]
    assert leaks(spark, others, passages) == set()


def test_leak_of_a_repetitive_passage():
    """Chance runs of repeated pieces do not push the true run out."""
    rng = random.Random(0)
    key = "".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(16)) + "甲乙丙丁戊己庚辛" for _ in range(24))
    copy = list(key[:384])
    for i in range(8, 384, 24):
        copy[i : i + 2] = "口口"
    found = leakage.Passages([(0, key)]).found(["", "开头" + "".join(copy) + "完全不同的结尾"])
    assert [f[:2] for f in found] == [(1, 0)] and found[0][2] >= 0.6


def test_hits_equal_a_plain_search():
    rng = random.Random(7)
    items = [(n, "".join(rng.choices("甲乙丙丁戊己", k=rng.randint(20, 60)))) for n in range(12)]
    passages = leakage.Passages(items)
    doc = "".join(rng.choices("甲乙丙丁戊己庚", k=400))
    codes = leakage._codes(doc).astype("uint64")
    got = {(p.width, *h) for p in passages.pieces for h in zip(*(x.tolist() for x in p.hits(codes)))}
    want = set()
    for n, (k, (w, _)) in enumerate(zip(passages.keys, passages.cut)):
        for at in range(0, len(k) - w + 1, w):
            want |= {(w, d, n, at) for d in range(len(doc) - w + 1) if doc[d : d + w] == k[at : at + w]}
    assert got == want and len(want) > 100


def test_evenly_spread_errors_leak():
    """One wrong letter in ten or eight, evenly, over all or 60 % of a passage."""
    rng = random.Random(8)
    keys = ["".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(n)) for n in (40, 100, 300) for _ in range(10)]
    passages = leakage.Passages(list(enumerate(keys)))
    for part in (1, 0.6):
        for step in (10, 8):
            texts = ["前文" + "".join("q" if i % step == step // 2 else c for i, c in enumerate(k[: int(len(k) * part)])) + "后文完全不同" for k in keys]
            assert {f[:2] for f in passages.found(texts)} == {(i, i) for i in range(30)}


def test_leaks_of_long_documents(monkeypatch):
    """Documents looked at in parts give what they give as a whole."""
    rng = random.Random(12)
    keys = ["".join(chr(0x4E00 + rng.randrange(900)) for _ in range(n)) for n in (60, 120, 200) for _ in range(4)]
    passages = leakage.Passages(list(enumerate(keys)))
    filler = ["".join(chr(0x4E00 + rng.randrange(900)) for _ in range(400)) for _ in keys]
    doc = "".join(f + k[: len(k) // 3] + f[:90] + k[len(k) // 2 :] for k, f in zip(keys, filler))
    whole = sorted(passages.found([doc]))
    assert {f[1] for f in whole} == set(range(12))
    for letters in (150, 500, 1000):
        monkeypatch.setattr(leakage, "LETTERS", letters)
        assert sorted(passages.found([doc, doc])) == sorted([*whole, *((1, *f[1:]) for f in whole)])


def test_leak_edges(spark):
    long = "啊" * 30_000 + PASSAGE
    assert leaks(spark, [long, PASSAGE, PASSAGE], (PASSAGE, None, "", "短", PASSAGE)) == {(d, i) for d in range(3) for i in (0, 4)}
    assert leaks(spark, [PASSAGE], (PASSAGE, PASSAGE[::-1], "x" * 50), block=1) == {(0, 0)}
    english = "The insured person recorded a healed surgical scar shortly before landing and forwarded the amended itinerary to the reviewing desk. " * 2
    assert leaks(spark, [english.upper().replace(" ", "  ")], (english,)) == {(0, 0)}
    assert leaks(spark, [], (PASSAGE,)) == set() and leaks(spark, [PASSAGE], ()) == set()


def test_loose_matter_that_is_not_redundant():
    """Verses, program text, recipes, tables and contents have no full stops but repeat little."""
    texts = [
        "Please see https://www.example.com/guide for the full text of the policy before you file a claim",
        "The road goes on beyond the hill\nand evening settles, blue and still\na lantern swings beside the door\nthe tide retreats along the shore\nno letter came, no voice, no sign\nthe stars come out in single line",
        "床前明月光\n疑是地上霜\n举头望明月\n低头思故乡\n白日依山尽\n黄河入海流\n欲穷千里目\n更上一层楼",
        "def add(a, b):\n    return a + b\n\nfor i in range(10):\n    print(add(i, 2))\nclass Foo(Bar):\n    def __init__(self, x, y):\n        self.x = x\n        self.y = y\n    def area(self):\n        return self.x * self.y\n",
        "2 cups flour\n1 teaspoon salt\n3 eggs\n1 cup milk\nbutter for the pan\nmix the flour and the salt\nbeat the eggs into the milk\nstir everything together\nrest the batter for an hour\nfry thin pancakes on both sides",
        "name,age,city\nAlice,34,Berlin\nBob,28,Paris\nCarla,41,Rome\nDmitri,52,Riga\nEva,19,Oslo\nFarid,33,Tunis\nGrace,45,Dublin\nHugo,38,Porto",
        "第一章 总则\n第二章 保险责任\n第三章 责任免除\n第四章 保险金额与保险费\n第五章 保险期间\n第六章 投保人义务\n第七章 赔偿处理\n第八章 争议处理\n第九章 其他事项",
    ]
    assert [spam.stuffing(t) for t in texts] == [0] * len(texts)


def test_blocks_of_loose_matter():
    loose = ["a" * 5000, "bb", "c" * 1999, *["d" * 10] * 700]
    found = spam.blocks(loose)
    assert "".join("".join(b) for b in found) == "".join(loose) and max(sum(map(len, b)) for b in found) <= 2 * spam.BLOCK
    assert spam.blocks([]) == [] and 0.19 < spam.usual_ratio(10**9, True) < spam.usual_ratio(1, True)


def test_bounds_of_stuffing(spark):
    prose = "患者今日复诊,右膝疼痛较前减轻,查体见局部轻度肿胀,活动稍受限。嘱继续服药并于两周后复查。"
    english = "The claimant forwarded the translated discharge note. The branch office recorded a delayed connection because of dense fog. "
    keywords = "低价机票 护膝批发 拐杖厂家 低价机票 低价机票 护膝批发 " * 8
    cases = {
        keywords: True, "\n".join(keywords.split()): True, "#低价 #护膝 #拐杖 #机票 #骨折 #膏药 #理赔 #代办": True,
        "\n".join(f"https://www.a{i}.example?id={i}" for i in range(30)): True, "\n".join(f"[机票]({i}.x.test)" for i in range(30)): True,
        "护膝哪家好?护膝多少钱?护膝批发?护膝推荐?" * 8: True, "cheap flights | visa help | cheap flights | " * 20: True, "¥12.50 包邮 拐杖A1 正品 ¥99.00 颈托B2 现货 包邮 护膝C3": True,
        keywords + prose: True, prose: False, prose * 10: False, english * 5: False, prose * 6 + keywords[:100]: False, prose * 3 + "\nhttps://www.a.example/b\n#标签": False,
        "血红蛋白\t63.8\tg/L\n肌酐\t197.4\tmg/L\n血钾\t3.1\tmmol/L\n白细胞\t9.1\t10^9/L": False, "阿莫西林胶囊\n维生素片\n头孢颗粒\n氯化钠注射液\n眼用凝胶": False, "": False, " \n ": False,
    }
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*cases, None, *cases])], "doc_id long, text string, stuffing int")
    got = {r.doc_id for r in spam.find_stuffed(df).collect()}
    n = len(cases)
    for i, (t, want) in enumerate(cases.items()):
        assert (i in got, i + n + 1 in got) == (want, want), t[:40]
    assert n not in got and spam.find_stuffed(df.limit(0)).count() == 0
    assert spam.stuffing("低价机票 " * 60_000) > 0.9


def test_texts_are_dealt_few_times(spark, monkeypatch):
    """A training text goes to one group, an evaluation text to those of near lengths; groups
    that are split, on both sides, lose no pair."""
    rng = random.Random(11)
    texts = ["".join(rng.choices("甲乙丙丁戊己庚辛", k=rng.randint(10, 400))) for _ in range(300)]
    copies = [changed(t, 0.1, rng) for t in texts[:90]]
    rows = [(i, t, True, False) for i, t in enumerate(texts)] + [(1000 + i, t, False, True) for i, t in enumerate(copies)]
    df = spark.createDataFrame(rows, "rep long, text string, in_train boolean, in_eval boolean")
    near = {(1000 + i, j) for i, x in enumerate(copies) for j, y in enumerate(texts) if overlap.within(x, y, max(len(x), len(y)) // 5) * 5 <= max(len(x), len(y))}
    left, right, _ = overlap.dealt(df)
    assert 290 < right.count() <= 300 and left.count() <= 5 * 90
    for smallest, largest in ((1_000_000, 16_000_000), (900, 2000)):
        monkeypatch.setattr(overlap, "SMALLEST", smallest)
        monkeypatch.setattr(overlap, "LARGEST", largest)
        groups = overlap.dealt(df)[2]
        assert (groups > 60) == (smallest == 900)
        got = [(r.rep_eval, r.rep_train) for r in overlap.near_texts(df).collect()]
        assert len(set(got)) == len(got) and set(got) == near and len(near) >= 85


def test_texts_between_steps_are_compressed(spark, data):
    """The texts are written once as compressed files, not as an uncompressed checkpoint."""
    df = overlap.overlaps(spark.read.parquet(f"{data}/examples.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and all(f.endswith(".zstd.parquet") for f in df.inputFiles())
