"""One consistent form for text that looks the same (pure Python kernels).

The kernels here work on one string and are called from Arrow-batched UDFs.
Method: resolve the script set of every letter, intersect the sets over each
token, detect tokens of mixed script and tokens written wholly in a look-alike
script, rewrite those in the script in which *every* letter can be spelled,
and bring the remaining variant forms (full-width, compatibility ideographs,
radicals, combining marks, invisibles, odd spaces) to their plain form.
"""

from __future__ import annotations

import re
import unicodedata

# --- fixed values -----------------------------------------------------------
# Letters of other scripts and the Latin letter of the same look.
CYRILLIC = "АВЕКМНОРСТУХІЈЅԚԜ" "аеорсухіјѕһкԁԛԝӏ"
CYRILLIC_AS_LATIN = "ABEKMHOPCTYXIJSQW" "aeopcyxijshkdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ονρικυχ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYX" "ovpikux"
# Radicals without a compatibility decomposition and their ideographs.
RADICALS = "⺟⺠⻄⻅⻆⻉⻋⻓⻔⻘⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰"
RADICALS_AS_HAN = "母民西见角贝车长门青页风飞食马骨鬼鱼鸟麦黄齐齿龙"
#: Word that stands for a line break in ``examples.words``.
LINE_BREAK = "mjwemptymjw"
# ----------------------------------------------------------------------------

TO_LATIN = {**dict(zip(CYRILLIC, CYRILLIC_AS_LATIN)), **dict(zip(GREEK, GREEK_AS_LATIN))}

def _table() -> dict[int, str | None]:
    t: dict[int, str | None] = {}
    for o in [*range(0x80, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        c = chr(o)
        kind = unicodedata.category(c)
        if kind == "Cf" or o in (0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
            t[o] = None
        elif kind == "Zs":
            t[o] = " "
        elif kind in ("Zl", "Zp"):
            t[o] = "\n"
        elif 0xFF01 <= o <= 0xFF5E:
            t[o] = chr(o - 0xFEE0)
        elif o in (0xB5, 0x2126, 0x212A, 0x212B) or 0x2E80 <= o <= 0x2FDF or 0xF900 <= o <= 0xFAFF or 0xFB00 <= o <= 0xFB06 or 0x2160 <= o <= 0x217F or o >= 0x1D400:
            n = unicodedata.normalize("NFKC", c)
            if n != c:
                t[o] = n
    t.update((ord(a), b) for a, b in zip(RADICALS, RADICALS_AS_HAN))
    return t


TABLE = _table()


def ranges(points: set[int]) -> list[tuple[int, int]]:
    """Runs of consecutive code points."""
    out: list[list[int]] = []
    for o in sorted(points):
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return [(a, b) for a, b in out]


def _char_class(points: set[int], java: bool) -> str:
    """A regex character class, in escapes of Java or of Python."""

    def one(o: int) -> str:
        return f"\\u{o:04x}" if o < 0x10000 else f"\\x{{{o:x}}}" if java else f"\\U{o:08x}"

    return "[" + "".join(f"{one(a)}-{one(b)}" for a, b in ranges(points)) + "]"


_points = set(TABLE) | set(range(0x300, 0x370)) | set(map(ord, TO_LATIN))
#: Characters of clean texts, which the wider class below must not hold (fixed values).
COMMON = set(map(ord, "αβγμ·—–…“”‘’、。《》「」『』【】〈〉〔〕éèêëüúùûöóòôñíîïáàâäåçß°±×÷²³"))


def _wider(points: set[int]) -> set[int]:
    """``points`` and what stands in small gaps between them, if that is nothing common:
    fewer ranges make a class that is matched faster."""
    out = set(points)
    for (_, a), (b, _) in zip(ranges(points), ranges(points)[1:]):
        gap = set(range(a + 1, b))
        if len(gap) <= 400 and not gap & COMMON and not gap & set(range(0x4E00, 0xA000)):
            out |= gap
    return out


#: Class (of Java) of everything that can make a text need rewriting and some rare
#: characters more; texts without a hit are in the one form already.
SUSPECT = _char_class(_wider(_points), True)
suspect = re.compile(_char_class(_points, False))
_token = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0300-\u036f\u0370-\u03ff\u0400-\u052f]+")
_other_script = re.compile(r"[\u0370-\u03ff\u0400-\u052f]")
_marks = re.compile(r"[\u0300-\u036f]")


def _script(c: str) -> str:
    o = ord(c)
    return "Grek" if 0x370 <= o <= 0x3FF else "Cyrl" if 0x400 <= o <= 0x52F else "Zinh" if 0x300 <= o <= 0x36F else "Latn"


def spellings(c: str) -> set[str]:
    """Scripts in which the look of ``c`` can be written (its resolved set)."""
    own = _script(c)
    if own == "Zinh":
        return {"Latn", "Grek", "Cyrl"}
    return {own, "Latn"} if c in TO_LATIN else {own}


def respell(token: str) -> str:
    """The consistent spelling of one token.

    The resolved sets are intersected; when Latin remains, every look-alike is
    replaced. A token with no common script (``μmol``) is legitimate mixture
    and stays, as does a single small Greek letter used as a symbol."""
    if not _other_script.search(token):
        return token
    if len(token) == 1 and token in "νρικυχ":
        return token
    common = {"Latn", "Grek", "Cyrl"}
    for c in token:
        common &= spellings(c)
    if "Latn" in common:
        return "".join(TO_LATIN.get(c, c) for c in token)
    if len({_script(c) for c in token} - {"Zinh"}) > 1:
        # no single script fits: fix the parts between letters that have only
        # their own look (a Greek unit sign glued to a Latin word, say)
        parts = re.split(r"([^A-Za-z\u00c0-\u024f\u0300-\u036f" + CYRILLIC + GREEK + "]+)", token)
        if len(parts) > 1:
            return "".join(respell(p) if i % 2 == 0 and p else p for i, p in enumerate(parts))
    return token


def _only_own(token: str) -> bool:
    """Whether a token is of another script beyond doubt: letters of one script, of
    which some have no Latin look; one or two Greek letters are symbols."""
    scripts = {_script(c) for c in token} - {"Zinh"}
    if scripts == {"Grek"} and len(token) < 3:
        return False
    return len(scripts) == 1 and "Latn" not in scripts and any(c not in TO_LATIN for c in token)


def respelled(s: str) -> str:
    """``s`` with the consistent spelling of its tokens; the length is kept.

    A token written wholly in letters that look Latin (a Cyrillic ``сор``) stays as it is
    beside a token of its script that cannot be Latin; then the text is in that script."""
    tokens = list(_token.finditer(s))
    sure = [_only_own(m[0]) for m in tokens]
    out, at = [], 0
    for i, m in enumerate(tokens):
        near = (j for j in (i - 1, i + 1) if 0 <= j < len(tokens) and sure[j])
        whole = {_script(c) for c in m[0]} - {"Zinh"}
        if len(whole) == 1 and "Latn" not in whole and any(_script(tokens[j][0][0]) in whole for j in near):
            continue
        out += [s[at : m.start()], respell(m[0])]
        at = m.end()
    return "".join(out) + s[at:]


def canon(s: str) -> str:
    """The one consistent form of ``s`` (null-free; see :func:`variants`)."""
    if s.isascii() or not suspect.search(s):
        return s
    s = s.translate(TABLE)
    if _marks.search(s):
        s = unicodedata.normalize("NFC", s)
    if _other_script.search(s):
        s = respelled(s)
    return s


def has_variant(s: str) -> bool:
    """Whether bringing ``s`` to the one form changes it or drops a mark."""
    if s.isascii() or not suspect.search(s):
        return False
    return bool(_marks.search(s)) or canon(s) != s


def canon_aligned(pieces: list[str | None]) -> tuple[str, list[int]]:
    """The one form of the joined ``pieces`` with, for each of its characters,
    the index of the piece it came from. Line-break words become ``\\n``."""
    out: list[str] = []
    at: list[int] = []
    hit = False
    for i, w in enumerate(pieces):
        if not w:
            continue
        if w == LINE_BREAK:
            out.append("\n")
            at.append(i)
            continue
        if not w.isascii() and suspect.search(w):
            hit = True
            w = w.translate(TABLE)
        out.append(w)
        at.extend([i] * len(w))
    s = "".join(out)
    if not hit:
        return s, at
    if _marks.search(s):
        # compose mark by mark so that the alignment is kept
        t: list[str] = []
        b: list[int] = []
        for c, i in zip(s, at):
            if "\u0300" <= c <= "\u036f" and t:
                n = unicodedata.normalize("NFC", t[-1] + c)
                if len(n) == 1:
                    t[-1] = n
                    continue
            t.append(c)
            b.append(i)
        s, at = "".join(t), b
    if _other_script.search(s):
        s = respelled(s)
    return s, at
