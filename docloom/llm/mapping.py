"""Problem 3: mapping freely typed values to the entries of a reference list.

Steps: deduplicate the values; normalise; retrieve candidates from an inverted
index of character n-grams; score them by idf-weighted cosine; accept above a
threshold and margin. Where the list itself tells what must not differ (the town, number
and kind of a hospital), and for slips in short Latin names, an exact check follows,
which tells a misspelt entry from a different one of high cosine (in the given lists other
towns, numbers and places reach 0.8); every other entry is accepted by its cosine
(``SURE``) and its lead over the next (``LEAD``), if its numbers are the same.

The prefix filter of the retrieval is exact: the rarest n-grams of a value are
looked up until the rest cannot reach the threshold any more, and only the
candidates found so are scored; an n-gram costs no more than its postings or the
candidates, whichever are fewer.

The list is shipped to the workers in blocks of at most ``block`` entries (a
documented size bound); longer lists are handled block by block and the block
winners compared, so the list may grow without bound.

Defined results: null values are not mapped (no row); an empty value maps to
-1; equal values share one row of the mapping; an empty list maps everything
to -1; ties within the margin are -1.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.textform import canon
from docloom.session import ship

# --- fixed values -----------------------------------------------------------
# Traditional characters and their simplified form (names of places, clinics).
TRADITIONAL = (
    "醫院縣區婦專傷腫溝灣關島橋鷺鶴澤煥礪螢鐸鵑磯駿鷗驪灘葦埡鏡澗嶼鯤漣霧嵐蓮鰲鰻蟬鸞塢霽瀟錦鐘鍾燁閣燦鷹壩絳楓鈞巒澱"
    "衛總術藥療診門東華龍馬蘇陽陰鄉鎮廣慶寧濟協軍學體綜國漢鄭劉陳張趙號眾與長開滬濱遼韋內圓廈濰綿賓萬"
    "嶺園莊圍窪漁鴻鳳蘆蘭楊樺灤瀝滄溫潤璣瓊綠綺蒼薊譚贛遠遙鈺銀雙雲靈飛騰驛魯鯉鱗鳥麗黃齊壟嶗嶠巖峽岡崗廬恆撫暉曉棟"
    "棲樂樓欒涇淶淺滸潔煒瑤瑩羅臨荊萊葉蕭藍觀豐輝邊鐵隴順風"
)
SIMPLIFIED = (
    "医院县区妇专伤肿沟湾关岛桥鹭鹤泽焕砺萤铎鹃矶骏鸥骊滩苇垭镜涧屿鲲涟雾岚莲鳌鳗蝉鸾坞霁潇锦钟钟烨阁灿鹰坝绛枫钧峦淀"
    "卫总术药疗诊门东华龙马苏阳阴乡镇广庆宁济协军学体综国汉郑刘陈张赵号众与长开沪滨辽韦内圆厦潍绵宾万"
    "岭园庄围洼渔鸿凤芦兰杨桦滦沥沧温润玑琼绿绮苍蓟谭赣远遥钰银双云灵飞腾驿鲁鲤鳞鸟丽黄齐垄崂峤岩峡冈岗庐恒抚晖晓栋"
    "栖乐楼栾泾涞浅浒洁炜瑶莹罗临荆莱叶萧蓝观丰辉边铁陇顺风"
)
# Characters that readers of scans take for one another.
LOOKALIKE = ("人入八", "民氏", "医匡臣区", "院完皖阮", "中申", "科料", "骨胃", "专传", "眼银", "肿肺", "瘤榴", "妇归", "幼幻", "保俣", "第弟", "市帀巿", "县具", "土士", "日曰", "己已巳", "未末")
# Short names of kinds of hospital.
SHORT = {"人民医院": ("人医",), "中医医院": ("中医院", "中医"), "妇幼保健院": ("妇幼院", "妇保院", "妇幼"), "骨伤专科医院": ("骨伤医院", "骨伤专科", "骨伤科医院"), "眼科医院": ("眼科专科医院", "眼科病院"), "肿瘤医院": ("肿瘤专科医院", "肿瘤病院")}
NUMERALS = "一二三四五六七八九十"
# ----------------------------------------------------------------------------

#: Cosine from which an entry without such a check is accepted, and its lead.
SURE, SURE_PLACE, LEAD = 0.45, 0.6, 0.1
#: Least difference of cost to the next entry.
MARGIN = 0.02
_numerals = re.compile("[一二三四五六七八九十]|[0-9]+")
_simplify = str.maketrans(TRADITIONAL, SIMPLIFIED)
_alike = {a + b for g in LOOKALIKE for a in g for b in g if a != b}
_doubled = re.compile(r"(.)\1+")
WILD = "□*?口"
_keep_han = re.compile(r"[^一-鿿A-Z0-9□*?]")
_province = re.compile(r"^.{0,12}?(?:省|自治区)(?=.{2,}[市县区])")
_entry = re.compile(r"^(.+?)([市县区])(?:第([一二三四五六七八九十]+))?(.+)$")
_number = re.compile(r"^[第弟]?([一二三四五六七八九十]|[0-9]{1,2})(?=.)")
_noise_py = re.compile(r"\(T?\d\)|\bT\d\b|\bINTL\b|\bINTERNATIONAL\b|[/ ]AIRPORT\b|#")
_lead_py = re.compile(r"^(?:DEST(?:INATION)?|FROM|TO|ORIGIN|DEPARTURE)(?:[ .:]+)")
_digits_py = str.maketrans("0152868", "OISZBGB")


def normalize_han(value: str) -> str:
    s = _keep_han.sub("", canon(value).upper().translate(_simplify))
    return _province.sub("", s)


def normalize_py(value: str) -> str:
    s = _lead_py.sub("", canon(value).upper().strip())
    s = re.sub(r"\s{2,}", "", s)
    s = _noise_py.sub("", s).translate(_digits_py)
    return re.sub(r"[^A-Z]", "", s)


def grams(s: str, n: int) -> list[str]:
    """Character n-grams of ``s`` with marked ends, and single characters for n = 2."""
    p = f"^{s}$"
    return list(s) * (n == 2) + [p[i : i + n] for i in range(len(p) - n + 1)]


def edit_cost(a: str, b: str, free_tail: bool = False, most: float = 9.0) -> float:
    """Edit cost from ``a`` to ``b``: look-alikes cost a quarter, swaps of
    neighbours one; with ``free_tail`` anything after the match in ``a`` is free."""
    prev2: list[float] = []
    prev = [float(j) for j in range(len(b) + 1)]
    best = prev[-1]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            c = prev[j - 1] + (0.0 if x == y else 0.25 if x + y in _alike else 1.0)
            if prev[j] + 1 < c:
                c = prev[j] + 1
            if row[-1] + 1 < c:
                c = row[-1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and prev2[j - 2] + 1 < c:
                c = prev2[j - 2] + 1
            row.append(c)
        prev2, prev = prev, row
        best = min(best, row[-1])
        if not free_tail and min(row) > most:
            return most + 1
    return best if free_tail else prev[-1]


def by_cosine(value: str, entry: str, cosine: float, least: float) -> float:
    """Cost of an entry that only its cosine speaks for; other numbers rule it out."""
    if value == entry:
        return 0.0
    part = len(value) >= 4 and value in entry  # a name cut short
    if not part and (cosine < least or _numerals.findall(value) != _numerals.findall(entry)):
        return 9.0
    return MARGIN / LEAD * (1 - cosine)


class HospitalCheck:
    """Whether a value means an entry: same town, same number, same kind."""

    def __init__(self, entries: list[str]):
        self.parsed = {}
        kinds = set()
        for e in entries:
            s = normalize_han(e)
            m = _entry.match(s)
            self.parsed[e] = (m[1], m[2], m[3] or "", m[4]) if m else (s, "", "", "")
            kinds.add(self.parsed[e][3])
        self.names = {k: (k, *SHORT.get(k, ())) for k in kinds}
        self._kind: dict[str, list[tuple[float, str]]] = {}

    def kinds(self, rest: str) -> list[tuple[float, str]]:
        """Kinds by cost of reading ``rest`` as one of their names."""
        if rest not in self._kind:
            flat = _doubled.sub(r"\1", rest)
            scored = []
            for k, names in self.names.items():
                cost = min(min(edit_cost(r, n, True), edit_cost(r, _doubled.sub(r"\1", n), True)) / max(2, len(n)) + (0.01 if n != k else 0) for n in names for r in {rest, flat})
                scored.append((cost, k))
            self._kind[rest] = sorted(scored)
        return self._kind[rest]

    def cost(self, value: str, entry: str, cosine: float = 0.0) -> float:
        """0 for a clean match, below 1 for an acceptable one, else 9."""
        town, unit, number, kind = self.parsed[entry]
        if not kind:
            return by_cosine(value, town, cosine, SURE)
        best = 9.0
        flat = _doubled.sub(r"\1", value)
        for v in (value,) if flat == value else (value, flat):
            for at in range(len(v) - len(town) + 1):
                part = v[at : at + len(town)]
                off = [i for i, (x, y) in enumerate(zip(part, town)) if x != y]
                if off and not (len(off) == 1 and len(town) > 1 and part[off[0]] in WILD):
                    continue
                best = min(best, 0.2 * len(off) + self._after(v[at + len(town) :], unit, number, kind))
        return best

    def _after(self, rest: str, unit: str, number: str, kind: str) -> float:
        paid = 0.0
        if rest[:1] and (rest[0] == unit or rest[0] + unit in _alike):
            rest = rest[1:]
            if rest[:1] == unit:
                rest = rest[1:]
        elif rest[:1] and rest[0] in "市县区":
            return 9.0
        else:
            paid = 0.05
        rest = _doubled.sub(r"\1", rest) if _number.match(rest) or rest[:1] in "第弟" else rest
        m = _number.match(rest)
        if m and rest[0] not in "第弟" and rest[m.end()] in "民氏":
            m = None  # a misread 人
        if m:
            n = m[1] if m[1] in NUMERALS else (NUMERALS[int(m[1]) - 1] if 0 < int(m[1]) <= 10 else "?")
            if n != number:
                return 9.0
            rest = rest[m.end() :]
            if kind == "人民医院" and rest[:1] and (edit_cost(rest, "院", True) < 0.5 or edit_cost(rest, "医院", True) < 0.5):
                if not any(edit_cost(rest, o, True) / len(o) < 0.3 for k, o in ((k, o) for k, v in self.names.items() for o in v) if k != kind):
                    return paid + 0.1
        elif number:
            return 9.0
        if not rest:
            return 9.0
        ranked = self.kinds(rest)
        if ranked[0][1] != kind or ranked[0][0] > 0.35 or (len(ranked) > 1 and ranked[1][0] - ranked[0][0] < 0.05):
            return 9.0
        return paid + ranked[0][0]


class PlaceCheck:
    """Whether a Latin place name means an entry: one slip (a letter in four of
    names close in cosine), or cut short."""

    def __init__(self, entries: list[str], least_part: float = 0.5):
        self.least_part = least_part

    def cost(self, value: str, entry: str, cosine: float = 0.0) -> float:
        if value == entry:
            return 0.0
        for tail in ("XX", "CITY", "AIRPORT", "INTL"):
            if value == entry + tail:
                return 0.05
        for head in ("FROM", "TO", "DEST"):
            if value == head + entry:
                return 0.05
        if abs(len(value) - len(entry)) <= 1 and edit_cost(value, entry, most=1.0) <= 1.0:
            return 0.3
        if len(value) >= 4 and len(value) >= self.least_part * len(entry) and (entry.startswith(value) or entry.endswith(value)):
            return 0.6
        if cosine < SURE_PLACE or edit_cost(value, entry, most=len(entry) // 4) > len(entry) // 4:
            return 9.0
        return 0.7 + by_cosine(value, entry, cosine, SURE_PLACE)


class Index:
    """Inverted n-gram index over one block of list entries."""

    def __init__(self, entries: list[tuple[int, str]], normalize: Callable[[str], str], n: int, check, threshold: float, margin: float):
        self.n, self.normalize, self.threshold, self.margin = n, normalize, threshold, margin
        self.entries = entries
        self.check = check([e for _, e in entries])
        vectors = [Counter(grams(normalize(e), n)) for _, e in entries]
        df = Counter(g for v in vectors for g in v)
        total = max(1, len(entries))
        self.idf = {g: math.log(1 + total / d) for g, d in df.items()}
        self.unseen = math.log(1 + 2 * total)
        self.post: dict[str, dict[int, int]] = defaultdict(dict)
        self.norm = []
        for i, v in enumerate(vectors):
            self.norm.append(math.sqrt(sum((c * self.idf[g]) ** 2 for g, c in v.items())) or 1.0)
            for g, c in v.items():
                self.post[g][i] = c

    def candidates(self, s: str) -> list[tuple[float, int]]:
        """``(cosine, entry)`` of every entry at or above the threshold."""
        v = Counter(grams(s, self.n))
        w = sorted(((self.idf.get(g, self.unseen), g, c) for g, c in v.items()), reverse=True)
        squares = [(x * c) ** 2 for x, _, c in w]
        whole = sum(squares)
        if not whole:
            return []
        left, limit, found = whole, whole * self.threshold**2, set()
        for (x, g, c), q in zip(w, squares):
            if left < limit:
                break
            left -= q
            found.update(self.post.get(g, ()))
        dot = dict.fromkeys(found, 0.0)
        for x, g, c in w:
            hits, q = self.post.get(g), x * x * c
            if not hits:
                continue
            # a frequent n-gram costs no more than the candidates
            if len(hits) < len(dot):
                for i, k in hits.items():
                    if i in dot:
                        dot[i] += q * k
            else:
                for i in dot:
                    if i in hits:
                        dot[i] += q * hits[i]
        root = math.sqrt(whole)
        return sorted(((d / root / self.norm[i], i) for i, d in dot.items() if d / root / self.norm[i] >= self.threshold), reverse=True)

    def best(self, value: str) -> tuple[int, float, float]:
        """``(list_pos or -1, cost, runner-up's cost)``."""
        s = self.normalize(value)
        scored = sorted((self.check.cost(s, self.entries[i][1], c), -c, self.entries[i][0]) for c, i in self.candidates(s))
        if not scored or scored[0][0] >= 1:
            return -1, 9.0, 9.0
        return scored[0][2], scored[0][0], scored[1][0] if len(scored) > 1 else 9.0


LISTS = {"hospital": (normalize_han, 2, HospitalCheck, 0.2), "place_py": (normalize_py, 2, PlaceCheck, 0.2)}


def map_values(values: DataFrame, value: str, reference: DataFrame, list_name: str, margin: float = MARGIN, block: int = 50_000) -> DataFrame:
    """``(value, list_pos)`` for every distinct non-null value: the entry meant or -1.

    ``reference`` has ``list_pos`` and ``value``."""
    ship(values.sparkSession)
    normalize, n, check, threshold = LISTS[list_name]
    # few bytes but much work per value: spread over the cores by number (not by
    # value, which Spark would take for the partitioning that is there already
    # and coalesce by size)
    cores = values.sparkSession.sparkContext.defaultParallelism
    distinct = values.select(F.col(value).alias("value")).where("value is not null").distinct().repartition(2 * cores)
    ref = reference.select(F.col("list_pos").cast("int").alias("list_pos"), F.col("value").alias("entry")).where("entry is not null")
    size = ref.count()
    found = None
    for k in range(max(1, -(-size // block))):
        part = ref if size <= block else ref.where(F.pmod(F.xxhash64("entry"), F.lit(-(-size // block))) == k)
        entries = sorted((r["list_pos"], r["entry"]) for r in part.collect())  # at most about ``block`` entries

        def scan(batches: Iterator[pd.DataFrame], entries=entries) -> Iterator[pd.DataFrame]:
            index = Index(entries, normalize, n, check, threshold, margin)
            for b in batches:
                out = [index.best(v) for v in b["value"]]
                yield pd.DataFrame({"value": b["value"], "list_pos": [o[0] for o in out], "cost": [o[1] for o in out], "next_cost": [o[2] for o in out]})

        one = distinct.mapInPandas(scan, "value string, list_pos int, cost double, next_cost double")
        found = one if found is None else found.unionByName(one)
    if size > block:
        w = Window.partitionBy("value").orderBy("cost", "list_pos")
        found = (
            found.withColumn("next_cost", F.least("next_cost", F.coalesce(F.lead("cost").over(w), F.lit(9.0))))
            .withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
        )
    sure = F.col("next_cost") - F.col("cost") >= margin
    return found.select("value", F.when(sure, F.col("list_pos")).otherwise(F.lit(-1)).alias("list_pos"))


def map_mentions(mentions: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(mention_id, category, value, list_name, list_pos)`` for every mention of
    a listed category with a non-null value."""
    lists = F.when(F.col("category") == "Hospital_Name", "hospital").when(F.col("category").isin("Origin_PY", "Destination_PY"), "place_py")
    m = mentions.select("mention_id", "category", "value", lists.alias("list_name")).where("list_name is not null and value is not null")
    mapped = None
    for name in LISTS:
        one = map_values(m.where(F.col("list_name") == name), "value", gazetteer.where(F.col("list_name") == name), name).withColumn("list_name", F.lit(name))
        mapped = one if mapped is None else mapped.unionByName(one)
    return m.join(mapped, ["list_name", "value"])
