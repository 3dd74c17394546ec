"""Problem 2: personal information inside free text.

Anchor expansion: one Aho-Corasick pass finds at-signs, digits, units of addresses and
words that announce or follow a person; local parsers then expand an anchor to the
item's bounds and validate it (dates of birth, area and country codes, house numbers,
name characters). Digit runs are read from their first digit on, with a letter, bracket
or plus sign before it. Only names without any cue are looked for by their form. Texts
are read in their one consistent form with an alignment back to the original positions.

Defined results: null or empty texts have no items; null words are skipped;
items never overlap (e-mail before identity number, phone, address, name);
texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.textform import LINE_BREAK, canon_aligned

# --- fixed values -----------------------------------------------------------
SURNAMES_2 = ("欧阳", "司马", "诸葛", "上官", "慕容", "令狐", "皇甫", "尉迟", "公孙", "夏侯", "东方", "司徒", "端木", "南宫", "独孤", "长孙", "宇文", "轩辕", "闻人", "澹台", "淳于", "申屠", "太史", "钟离")
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳"
    "鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊"
    "纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫房解应宗丁宣邓郁单杭洪包左石"
    "崔吉钮龚程嵇邢裴陆荣翁荀惠甄曲封芮储靳段焦巴弓牧车侯班仰仲伊宁仇栾甘厉戎祖武符刘景詹束龙叶幸司韶黎白怀蒲从索赖卓蔺屠蒙"
    "池乔闻党翟谭贡劳申冉桑桂牛边燕冀浦尚温庄晏柴瞿阎连习容向古易廖耿匡文寇广欧沃利越隆师巩聂晁勾敖冷辛阚那简饶曾沙鞠丰关查红游权岳帅肖涂代"
)
# Characters that occur in given names and hardly in other words.
GIVEN = (
    "霖湉菁琬恺屹蔚渊颀妤奕澍桐璟煜弈岚槿霁晗楠旻钰珺昀玥瑾沐骁峤澜棠曦蘅淇筠睿茗皓芷朗栩翊砚绮"
    "萱婷颖琪琳娜倩怡蕾薇媛婧梓涵轩泽宇浩昊俊杰辉鑫磊鹏斌宁超雯莹妍瑶瑜琦琛璇彤欣悦佳嘉伟刚勇强军敏静丽艳芳娟霞燕玲桂兰"
)
RARE_GIVEN = GIVEN[: GIVEN.index("萱")]
EMAIL_CUES = ("email", "e-mail", "mail")
NAME_CUES = ("患者姓名", "患者", "伤者", "旅客", "姓名", "NAME", "Name", "name", "审核", "主治医师", "医师", "记录者", "联系人", "陪同者", "经手人", "家属", "护士", "被保险人", "投保人", "受益人", "代理人", "签名", "PASSENGER", "Passenger")
NAME_TAILS = ("代述病史", "补充说明", "未随行", "签字", "到场", "陪护", "女士", "先生")
NUMBER_CUES_OTHER = ("流水号", "票号", "条码", "@#", "#", "发票", "保单", "ETKT", "住院号", "病案号", "结算单", "单号", "编号", "标本", "订单", "航班", "CNY", "No.")
ADDRESS_CUES = ("户籍", "现住", "寄至", "住址", "家庭地址", "地址", "事发于", "居住", "寄往")
ROADS = ("大道", "路", "街", "巷", "弄", "胡同", "村", "里")
LATIN_ROADS = ("Road", "Rd", "Street", "St", "Lane", "Ln", "Avenue", "Ave", "Boulevard", "Blvd", "Drive", "Dr", "ROAD", "RD", "STREET", "LANE", "AVENUE", "road", "street", "lane", "avenue", "rd")
TITLES = ("MR", "MS", "MRS", "MSTR", "MISS")
# ----------------------------------------------------------------------------

KINDS = ("email", "id_number", "phone", "address", "person_name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

_han = "一-鿿"
_latin = "A-Za-zÀ-ÖØ-öø-ɏ"
_name_zh = f"(?:(?:{'|'.join(SURNAMES_2)})|[{SURNAMES}])"


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in ("@", "[at]", "(at)", "{at}", "<at>", "[AT]", "(AT)"):
        a.add_word(w, ("at", len(w)))
    for w in NAME_CUES:
        a.add_word(w, ("name", len(w)))
    for w in NAME_TAILS:
        a.add_word(w, ("tail", len(w)))
    for w in ("省", "自治区", "市", "区", "县"):
        a.add_word(w, ("unit", len(w)))
    for w in LATIN_ROADS:
        a.add_word(w, ("road", len(w)))
    for w in "0123456789":
        a.add_word(w, ("digit", 1))
    for w in ("·", "/"):
        a.add_word(w, ("dot" if w == "·" else "slash", 1))
    a.make_automaton()
    return a


AUTOMATON = _automaton()


def anchors_of(t: str) -> dict[str, list[tuple[int, int]]]:
    """``kind: (place, width)`` of the anchors of a text; of a run of digits the first."""
    anchors: dict[str, list[tuple[int, int]]] = {}
    last = -2
    for end, (kind, width) in AUTOMATON.iter(t):
        if kind == "digit":
            if end != last + 1:
                anchors.setdefault(kind, []).append((end, 1))
            last = end
        else:
            anchors.setdefault(kind, []).append((end + 1 - width, width))
    return anchors


def expanded(pattern: re.Pattern, t: str, anchors: list[tuple[int, int]], before: str) -> Iterator[re.Match]:
    """Matches of ``pattern`` from digit anchors on, or from a character of ``before``
    (letters if it is ``"A"``) in front of them; none within another."""
    end = 0
    for at, _ in anchors:
        if at < end:
            continue
        m = None
        if before == "A":
            k = at - 2 if t[at - 1 : at] == " " else at - 1
            if k >= 0 and t[k].isascii() and t[k].isalpha():
                m = pattern.match(t, k)
        elif at and t[at - 1] in before:
            m = pattern.match(t, at - 1)
        if m is None and before != "A":
            m = pattern.match(t, at)
        if m:
            end = m.end()
            yield m

_local = re.compile(r"[A-Za-z0-9._+\-]+$")
_domain = re.compile(r"[A-Za-z0-9\-]+(?:(?:\.|\[dot\]|\(dot\)|\{dot\}|\[DOT\]|\(DOT\))[A-Za-z0-9\-]+)+|[A-Za-z0-9\-]+(?: (?:dot|DOT) [A-Za-z0-9\-]+)+|[A-Za-z0-9\-]*dot[a-z]+|[A-Z0-9\-]*DOT[A-Z]+")
_digits = re.compile(r"(?<![0-9])(?:(?<![A-Za-z])|(?<=[Tt]el)|(?<=TEL)|(?<=tEL))(?:\+|\()?[0-9](?:[ .\-—–()]{0,2}[0-9]){6,}[Xx]?(?:(?:转|-|ext\.?|x)[0-9]{1,5})?")
_glued_cue = re.compile(rf"[0-9.\-]*(?:{'|'.join(EMAIL_CUES)})[._\-]?(?=[A-Za-z0-9])", re.I)
_word_at = re.compile(
    r"(?:(?:邮箱|电邮|发至|报告寄|[Mm]ail|MAIL)[:： ]*(?P<cued>[A-Za-z0-9._+\-]+?)(?: ?at ?| ?AT ?)|(?<![A-Za-z0-9._+\-])(?P<free>[A-Za-z0-9][A-Za-z0-9._+\-]*) (?:at|AT|\[at\]|\(at\)) )"
    r"[A-Za-z0-9\-]+?(?:(?:\.| ?dot ?| ?DOT ?)[A-Za-z0-9\-]+)+"
)
_passport_low = re.compile(r"(?<![0-9A-Za-z])[a-z][0-9]{8}(?![0-9A-Za-z\-])")
_passport = re.compile(r"(?<![0-9A-Za-z])[A-Z] ?[0-9]{8}(?![0-9A-Za-z\-])")
_id_after_letters = re.compile(r"(?<![0-9])(?:[0-9]{17}[0-9Xx]|[0-9]{15})(?![0-9A-Za-z])")
_mobile = re.compile(r"(?:\+?86|0086)?(1[3-9][0-9]{9})$")
#: Other countries' numbers: with a plus sign and country code, or in the form 3-3-4.
_abroad = re.compile(r"\+[1-9][0-9]{0,2}[ .\-—–()]{0,2}(?:[0-9][ .\-—–()]{0,2}){6,13}[0-9]$")
_ten = re.compile(r"\(?[2-9][0-9]{2}\)?[ .\-][2-9][0-9]{2}[.\-][0-9]{4}$")
_landline = re.compile(r"(?:\+?86|0086)?(0(?:10|2[0-9]|[3-9][0-9]{2})[0-9]{7,8})$")
_address = re.compile(
    rf"(?P<prov>[{_han}]{{2,3}}(?:省|自治区))?(?P<town>[{_han}]{{2}}[市区县])(?P<town2>[{_han}]{{2}}[市区县])?"
    rf"(?:[{_han}]{{2}}[镇乡])?[{_han}]{{1,3}}(?:大道|路|街|巷|弄|胡同|村|里)[0-9]{{1,4}}(?:号|组|弄|栋|幢)"
)
_address_loose = re.compile(rf"[{_han}□*?]{{2,4}}(?:省|自治区|市|区|县)[^\n。;；]{{0,14}}?(?:大道|路|街|巷|弄|胡同|村|镇|乡)[^\n。;；,]{{0,2}}[0-9]{{1,4}}(?:号|组)?")
_house = re.compile(rf"(?:[Nn][Oo]\.? ?[0-9]{{1,5}}[, ]?[A-Za-z][{_latin}]* ?|(?<![0-9])[0-9]{{1,5}}[, ]?[A-Z][a-zß-ɏ]+ ?)$")
_latin_tail = re.compile(rf"[{_latin}]*(?:, ?[A-Z][a-z]+)?")
_zh_tail = re.compile(r"(?:[0-9]+[幢栋](?:[0-9]+单元)?(?:[0-9]+室)?|[0-9]+-[0-9]+|[0-9]+号)?")
_dotted_left = re.compile(rf"[{_han}]{{2,5}}$")
_dotted_right = re.compile(rf"[{_han}]{{2,5}}")
_zh = re.compile(rf"{_name_zh}[{GIVEN}]{{1,2}}")
_zh_rare = re.compile(rf"{_name_zh}[{RARE_GIVEN}]{{1,2}}")
_zh_cued = re.compile(rf"(?:{_name_zh}[{GIVEN}]{{1,2}}|[{_han}]{{1,2}}?[{RARE_GIVEN}]{{1,2}}|{_name_zh}[{_han}□*?]{{1,2}}(?=[\n,。;；:、() ]|$|代述|补充|未随|签字|到场|陪护|另附|女士|先生))")
_west = re.compile(r"[A-Z][a-zß-ɏ]+ ?[A-Z][a-zß-ɏ]+")
_english = re.compile(r"[A-Z][a-z]+(?: [A-Z]\.?)?(?: [A-Z][a-z]+)+")
_addressed = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.? (?P<name>[A-Z][a-zß-ɏ]+(?: [A-Z][a-zß-ɏ]+)?)")
#: Words that may directly follow a name of three characters after a cue, characters
#: that such a name does not hold, and the field words that end any name.
_acts = "今日|昨日|自述|主诉|来院|就诊|致电|表示|要求"
_no_name = "左右上下高低中前后第一二三四五六七八九十双单侧"
_fields = "性别|年龄|科室|床号|住院号|病案号|电话|手机|身份证|证件|出生"
_zh_acting = re.compile(rf"(?=[^{_no_name}]{{3}}){_name_zh}[{_han}]{{2}}(?={_acts})|{_name_zh}[{_han}]{{1,2}}?(?={_fields})")
#: Two names joined, nothing else in their clause.
_zh_pair = re.compile(rf"(?:(?<=[\n,。;；:!！?？])|^)(?=[^{_no_name}])(?P<one>{_name_zh}[{_han}]{{1,2}})[和与](?=[^{_no_name}])(?P<two>{_name_zh}[{_han}]{{1,2}})(?=[\n,。;；!！?？]|$)")
_accent = re.compile(r"[ß-ɏ]")
_slash_left = re.compile(r"[A-Z]{2,}$")
_slash_right = re.compile(r"[A-Z]{2,}")
_caps = re.compile(r"[A-Z]{4,}(?![A-Z/])")
# a field word of which one letter was misread for something that is no letter
_wrong = r"[^A-Za-z\s,。;；:：/]"
_damaged = re.compile("|".join(f"(?<![A-Za-z]){w[:i]}{_wrong}{w[i + 1:]}(?=[A-Za-z:：一-鿿])" for w in ("PASSENGER", "NAME") for i in range(len(w))), re.I)
_field_word = re.compile(r"^(?:PASS?ENGER|PASSEN?G?E?R|PASS?N?EN?GER|PA?S?SENGER|NAME)(?=[A-Z]{2})")
_capital, _small = re.compile("[A-Z]"), re.compile("[a-z]{4}")
_to_capitals = {ord(c): c.upper() for c in "abcdefghijklmnopqrstuvwxyz"}
_bare_capitals = re.compile(r"(?:(?<=[\n,。;；])|^)(?!FLIGHT|DATE|GATE|SEAT|BOARDING|TERMINAL)[A-Z]{4,}(?=[\n,。;；]|$)")
_low_slash = re.compile(r"[a-z]{2,}/[a-z]{2,}")
_low_run = re.compile(r"[a-z]{4,}(?![A-Za-z0-9@._\-])")
_before_tail = re.compile(r"(?:[A-Z]{2,}/?[A-Z]{2,}|[a-z]{2,}/[a-z]{2,})$")
_titled = re.compile(r"(?<![A-Za-z/])(?!FROM)[A-Z]{3,}(?:MR|MS)(?![A-Za-z/])")
_edge = set("\n,。;；:、()（）/ .!?！？【】[]\"'")


def _valid_date(s: str) -> bool:
    y = int(s[:-4])
    if len(s) == 8 and not 1900 <= y <= 2026:
        return False
    return 1 <= int(s[-4:-2]) <= 12 and 1 <= int(s[-2:]) <= 31


def resident_card(d: str) -> bool:
    """Shape of a resident card number: region, date of birth, serial."""
    if len(d) == 18 and d[:17].isdigit() and (d[17].isdigit() or d[17] in "Xx"):
        return d[0] in "123456789" and _valid_date(d[6:14])
    return len(d) == 15 and d.isdigit() and d[0] in "123456789" and _valid_date(d[6:12])


_other_cue = re.compile("(?:" + "|".join(map(re.escape, NUMBER_CUES_OTHER)) + r")(?:号|码|为|是)?[:： ]*$")
_id_cue = re.compile(r"(?:证|ID|Id|身份|护照|持证)[^\n。;,]{0,6}$")


def _emails(t: str, at: int, width: int) -> tuple[int, int] | None:
    m = _local.search(t, max(0, at - 64), at)
    d = _domain.match(t, at + width)
    if not m or not d:
        return None
    start, local = m.start(), m[0]
    cue = _glued_cue.match(local)  # blanks between words may be lost
    if cue:
        start += cue.end()
    while start < at and not t[start].isalnum():
        start += 1
    return (start, d.end()) if start < at else None


def _repaired(m: re.Match) -> str:
    word = "PASSENGER" if len(m[0]) == 9 else "NAME"
    return word if m[0].upper() == m[0] else word.lower()


def with_slips(places: frozenset[str]) -> frozenset[str]:
    """The places and what is left of them when one letter is missing."""
    return places | {p[:i] + p[i + 1 :] for p in places for i in range(len(p))}


def near_place(s: str, places: frozenset[str]) -> bool:
    """Whether ``s`` is one of the places or one slip away from one
    (``places`` holds their forms with a letter missing, too)."""
    return s in places or any(s[:i] + s[i + 1 :] in places for i in range(len(s)))


def find_items(t: str, whole_is_name: bool = False, places: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every personal item in a canonical text.

    ``places`` are known Latin place names in capitals; with them, a line or
    clause of capitals alone that is none of them is read as a passenger's name."""
    t = _damaged.sub(_repaired, t)
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(t))

    def take(a: int, b: int, kind: str) -> None:
        if 0 <= a < b and not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind))

    anchors = anchors_of(t)
    digits = anchors.get("digit", [])
    for at, width in anchors.get("at", ()):
        span = _emails(t, at, width)
        if span:
            take(*span, "email")
    if "at" in t or "AT" in t:
        for m in _word_at.finditer(t):
            take(m.start("cued") if m["cued"] else m.start("free"), m.end(), "email")

    for m in expanded(_passport, t, digits, "A"):
        if not _other_cue.search(t, max(0, m.start() - 8), m.start()) or _id_cue.search(t, max(0, m.start() - 12), m.start()):
            take(m.start(), m.end(), "id_number")
    for m in expanded(_passport_low, t, digits, "A"):
        if _id_cue.search(t, max(0, m.start() - 12), m.start()):
            take(m.start(), m.end(), "id_number")
    for m in expanded(_digits, t, digits, "+("):
        _number(t, m, take)
    for m in expanded(_id_after_letters, t, digits, ""):
        if not taken[m.start()] and resident_card(m[0]) and _id_cue.search(t, max(0, m.start() - 8), m.start()):
            take(m.start(), m.end(), "id_number")

    if "unit" in anchors:
        for m in _address.finditer(t):
            _take_address(t, m, take)
        for cue in ADDRESS_CUES:
            k = t.find(cue)
            while k >= 0:
                a = k + len(cue)
                while a < len(t) and t[a] in ":： \n":
                    a += 1
                m = _address_loose.match(t, a)
                if m:
                    take(a, m.end(), "address")
                k = t.find(cue, k + 1)
    for at, width in anchors.get("road", ()):
        m = _house.search(t, max(0, at - 40), at)
        if m and m[0].rstrip()[-1].isalpha():
            tail = _latin_tail.match(t, at + width)
            take(m.start(), tail.end(), "address")

    if not _capital.search(t) and _small.search(t):
        # a text in small letters throughout: names are read as in capitals
        t = t.translate(_to_capitals)
        anchors = anchors_of(t)
    _names(t, anchors, take, taken, whole_is_name)
    if places:
        for m in _bare_capitals.finditer(t):
            if not near_place(m[0], places) and not m[0].startswith(("TO", "FROM", "NAME", "PASSENGER")) or _titled.fullmatch(m[0]):
                take(m.start(), m.end(), "person_name")
    return sorted(found)


def _number(t: str, m: re.Match, take) -> None:
    a, raw = m.start(), m[0]
    cue = _other_cue.search(t, max(0, a - 8), a)
    if cue and not _id_cue.search(t, max(0, a - 8), a):
        return
    body = re.split(r"(?:转|ext\.?|x(?=[0-9]))", raw)[0]
    tries = [(0, body)]
    # a space may stand between two numbers as well as within one
    if " " in body:
        tries += [(k.end(), body[k.end() :]) for k in re.finditer(r" +", body)] + [(0, body[: k.start()]) for k in re.finditer(r" +", body)]
    for off, s in tries:
        plain = re.sub(r"[ .\-—–()]", "", s)
        if resident_card(plain):
            lead = len(s) - len(s.lstrip("( "))
            take(a + off + lead, a + off + len(s), "id_number")
            return
    for off, s in tries:
        plain = re.sub(r"[ .\-—–()]", "", s)
        start = a + off
        lead = len(s) - len(s.lstrip(" "))
        cut = s
        if not (_mobile.match(plain) or _landline.match(plain)) and s.count("-") and len(s.rsplit("-", 1)[1]) <= 5:
            cut = s.rsplit("-", 1)[0]
            plain = re.sub(r"[ .\-—–()]", "", cut)
        if "." in cut and any(len(re.sub("[^0-9]", "", cut[: k.start()])) - len(plain) + 11 not in (3, 7) for k in re.finditer(r"\.", cut)):
            continue
        if _mobile.match(plain) or _landline.match(plain):
            if s.startswith("(") and not re.match(r"\(0\d{2,3}\)|\(\+?86\)", s):
                lead = 1
            end = m.end() if off + len(s) >= len(body) else start + len(s)
            take(start + lead, end, "phone")
            return
    whole = body.rstrip(" .-—–(")
    if (_abroad.match(whole) and 8 <= sum(map(str.isdigit, whole)) <= 15 and not re.match(r"\+86", whole)) or _ten.match(whole):
        take(a, a + len(whole), "phone")


def _take_address(t: str, m: re.Match, take) -> None:
    a = m.start()
    head = m["prov"]
    if head and len(head) - (3 if head.endswith("自治区") else 1) == 3:
        # the third character may belong to the words before
        before = t[max(0, a - 4) : a]
        cued = not before or before[-1] in _edge or any(before.endswith(c) for c in ADDRESS_CUES)
        if not cued:
            for c in ADDRESS_CUES:
                if (before + head[0]).endswith(c):
                    a += 1
                    break
            else:
                a += 1
    take(a, _zh_tail.match(t, m.end()).end(), "address")


def _take_zh(t: str, m: re.Match, take) -> int:
    take(m.start(), m.end(), "person_name")
    return m.end()


def _names(t: str, anchors, take, taken, whole_is_name: bool) -> None:
    n = len(t)
    for at, _ in anchors.get("dot", ()):
        left, right = _dotted_left.search(t, max(0, at - 5), at), _dotted_right.match(t, at + 1)
        if not left or not right:
            continue
        a = left.start()
        run = left[0]
        for cue in NAME_CUES + ("人", "者", "师"):
            k = run.rfind(cue)
            if k >= 0 and len(run) - k - len(cue) >= 2:
                a = max(a, left.start() + k + len(cue))
        if at - a > 3 or (a > 0 and t[a - 1] not in _edge and at - a > 3):
            a = at - 3
        take(a, min(at + 4, right.end()), "person_name")
    for m in _west.finditer(t):
        if _accent.search(m[0]):
            take(m.start(), m.end(), "person_name")
    for at, _ in anchors.get("slash", ()):
        left, right = _slash_left.search(t, max(0, at - 30), at), _slash_right.match(t, at + 1)
        if not left or not right:
            continue
        a = left.start()
        for cue in ("PASSENGER", "NAME"):
            k = left[0].rfind(cue)
            if k >= 0 and at - (left.start() + k + len(cue)) >= 2:
                a = left.start() + k + len(cue)
                break
        else:
            k = _field_word.match(left[0])
            a += k.end() if k else 0
        if right[0].startswith(("AIRPORT", "AL", "DL", "ML")) and len(right[0]) <= 2:
            continue
        take(a, right.end(), "person_name")
    for at, width in anchors.get("name", ()):
        a = at + width
        while a < n and t[a] in ":： \n" and a - at - width < 3:
            a += 1
        if a >= n or taken[a]:
            continue
        while True:
            m = _zh_cued.match(t, a) or _zh_acting.match(t, a)
            if not m:
                break
            end = _take_zh(t, m, take)
            if t[end : end + 1] in ("、", "和", "及") and end + 1 < n:
                a = end + 1
                continue
            break
        if not m and not taken[a]:
            c = _caps.match(t, a) or _low_slash.match(t, a) or (None if t[at].isascii() else _low_run.match(t, a))
            if c and not c[0].startswith(("FLIGHT", "DATE", "FROM", "PASSENGER", "NAME", "SEAT", "GATE")):
                take(a, c.end(), "person_name")
        if not m:
            w = _west.match(t, a)
            if w:
                take(w.start(), w.end(), "person_name")
    for at, _ in anchors.get("tail", ()):
        m = _before_tail.search(t, max(0, at - 40), at)
        if m:
            take(m.start(), m.end(), "person_name")
    for m in _titled.finditer(t):
        take(m.start(), m.end(), "person_name")
    for m in _addressed.finditer(t):
        take(m.start("name"), m.end(), "person_name")
    for m in _zh_pair.finditer(t):
        take(*m.span("one"), "person_name")
        take(*m.span("two"), "person_name")
    for m in _zh_rare.finditer(t):
        a, b = m.start(), m.end()
        if taken[a]:
            continue
        before, after = t[a - 1 : a], t[b : b + 1]
        bounded = after == "" or after in _edge
        if a == 0 or before in _edge or any(t.startswith(x, b) for x in NAME_TAILS) or (bounded and (before in "者客名" or b - a >= 3)):
            # a town (two characters) may begin like a given name
            if after in ("市", "县", "区") or (after and t[b + 1 : b + 2] in ("市", "县", "区") and b - a > 1 and after not in _edge):
                continue
            take(a, b, "person_name")
    if whole_is_name and not any(taken):
        core = t.strip()
        m = _zh.match(core)
        if m and m.end() == len(core):
            k = t.index(core)
            take(k, k + len(core), "person_name")
        elif _english.fullmatch(core):
            k = t.index(core)
            take(k, k + len(core), "person_name")
        elif re.fullmatch(r"[A-Z]{2,} ?[A-Z]{2,}(?: ?(?:MR|MS|MRS|MSTR|MISS))?", core) and " " in core:
            k = t.index(core)
            take(k, k + len(core), "person_name")


def _despaced(text: str, at: list[int]) -> tuple[str, list[int]]:
    """Without spaces, except one between digits; the alignment is kept."""
    if " " not in text:
        return text, at
    out, pos = [], []
    for i, c in enumerate(text):
        if c == " ":
            p = next((x for x in reversed(out[-1:]) if x), "")
            nxt = text[i + 1 : i + 2]
            if not (p.isdigit() and nxt.isdigit()):
                continue
        out.append(c)
        pos.append(at[i])
    return "".join(out), pos


def _unstray(text: str, at: list[int]) -> tuple[str, list[int]]:
    """Without stray spaces inside a word (after its first letter, or before
    its last one or two Han characters); other spaces stay as bounds."""
    if " " not in text:
        return text, at
    keep = [True] * len(text)
    for m in re.finditer(" +", text):
        a, b = m.span()
        if not (0 < a and b < len(text) and text[a - 1].isalpha() and text[b].isalpha()):
            continue
        before = re.split(r"[^\w·]", text[:a])[-1]
        after = re.split(r"[^\w·]", text[b:])[0]
        han = "一" <= text[a - 1] <= "鿿" and "一" <= text[b] <= "鿿"
        if len(before) == 1 or (han and len(after) <= 2):
            keep[a:b] = [False] * (b - a)
    return "".join(c for c, k in zip(text, keep) if k), [i for i, k in zip(at, keep) if k]


def items_of_words(words, places: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """``(first word, last word + 1, kind)`` of the items in a list of words."""
    t, at = canon_aligned(list(words))
    t, at = _despaced(t, at)
    return [(at[a], at[b - 1] + 1, k) for a, b, k in find_items(t, places=places)]


def items_of_value(value: str, is_name: bool = False) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the items in one value, in its own positions."""
    t, at = canon_aligned(list(value))
    if is_name and re.fullmatch(r"\s*[A-Z]{2,}(?: [A-Z]{2,}){1,2}\s*", t):
        a = len(t) - len(t.lstrip())
        return [(at[a], at[len(t.rstrip()) - 1] + 1, "person_name")]
    t, at = _unstray(t, at)
    return [(at[a], at[b - 1] + 1, k) for a, b, k in find_items(t, is_name)]


ITEM = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


#: Most place names that are sent to the workers; a longer list is an error.
MOST_PLACES = 100_000


def known_places(places: DataFrame | None, column: str = "value") -> frozenset[str]:
    """The place names of a table in capitals; more than ``MOST_PLACES``
    raise an error, as without them names in bare capitals would get lost."""
    if places is None:
        return frozenset()
    rows = places.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_PLACES + 1).collect()
    if len(rows) > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} place names")
    return with_slips(frozenset(r[0].upper() for r in rows))


def _word_items(places: frozenset[str]):
    @F.pandas_udf(ITEM)
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: None if w is None else [{"start": a, "end": b, "kind": k} for a, b, k in items_of_words(w, places)])

    return run


@F.pandas_udf(ITEM)
def _value_items(value: pd.Series, is_name: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else [{"start": a, "end": b, "kind": k} for a, b, k in items_of_value(v, bool(n))] for v, n in zip(value, is_name)], dtype=object)


def find_in_words(df: DataFrame, id_column: str, words: str = "words", places: DataFrame | None = None) -> DataFrame:
    """``(row_id, kind, start, end)`` of the items in an array of words; ``places``
    is a table of Latin place names (column ``value``)."""
    out = df.select(F.col(id_column).cast("bigint").alias("row_id"), F.explode(_word_items(known_places(places))(F.col(words))).alias("__i"))
    return out.select("row_id", "__i.kind", "__i.start", "__i.end")


def find_in_values(df: DataFrame, id_column: str, value: str, is_name) -> DataFrame:
    """``(row_id, kind, start, end)`` of the items in a string column; ``is_name``
    tells of which rows the whole value is expected to be a name."""
    out = df.select(F.col(id_column).cast("bigint").alias("row_id"), F.explode(_value_items(F.col(value), is_name)).alias("__i"))
    return out.select("row_id", "__i.kind", "__i.start", "__i.end")


def redact_words(df: DataFrame, words: str = "words", places: DataFrame | None = None) -> DataFrame:
    """``df`` with every item in ``words`` replaced by one placeholder of its kind."""
    known = known_places(places)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def redact(batch: pd.Series) -> pd.Series:
        def one(w):
            if w is None:
                return None
            out, at = [], 0
            for a, b, k in items_of_words(w, known):
                out.extend(w[at:a])
                out.append(PLACEHOLDER[k])
                at = b
            out.extend(w[at:])
            return out

        return batch.map(one)

    return df.withColumn(words, redact(F.col(words)))


def redact_values(df: DataFrame, value: str, is_name) -> DataFrame:
    """``df`` with every item in a string column replaced by its placeholder."""

    @F.pandas_udf(T.StringType())
    def redact(batch: pd.Series, names: pd.Series) -> pd.Series:
        def one(v, n):
            if v is None:
                return None
            out, at = [], 0
            for a, b, k in items_of_value(v, bool(n)):
                out.append(v[at:a] + PLACEHOLDER[k])
                at = b
            return "".join(out) + v[at:]

        return pd.Series([one(v, n) for v, n in zip(batch, names)], dtype=object)

    return df.withColumn(value, redact(F.col(value), is_name))
