"""Problem 9: keyword-stuffed and link-list pages.

Compression decides. Addresses and digits of a text are masked, and its segments
(lines, and sentences within them) are parted into sentences and loose matter: what
has no full stop, or none for ``LONG`` characters. The loose matter of a page is cut into
blocks of about ``BLOCK`` characters, and each block's compression ratio is divided by the
ratio that plain prose of that length and script has (``usual_ratio``). Blocks well
below it are extremely redundant; that they are loose matter, so that the density of
full stops is low, confirms them as stuffing. One link in a sentence, verses, program
text, recipes or contents lists have no full stops either but are not redundant.
Lines of laboratory values and drugs are redundant lists, too, but no stuffing.

A page is reported when at least ``share`` of its characters are stuffing. Everything
is decided per document from its whole text, so a scan is all that is needed. Defined
results: null, empty and blank texts are never reported; loose matter under ``LEAST``
characters is too short to be told; copies get the same verdict.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from docloom.llm.textform import canon
from docloom.session import spread

# --- fixed values -----------------------------------------------------------
LAB_UNIT = r"(?:[mμnpk]?mol|[mμnp]?g|kg|IU|U|10\^\d+)/(?:[mμ]?L|d|h|kg)|%|mmHg|bpm|fL|pg"
DRUG_FORM = "片|胶囊|颗粒|注射液|口服液|滴眼液|软膏|凝胶|丸|散|糖浆|贴|栓|喷雾|tablets?|capsules?|injection|ointment|syrup|drops"
# ----------------------------------------------------------------------------

#: Characters of a block; of a sentence, beyond which it counts as loose matter; of
#: loose matter, below which it is not looked at.
BLOCK, LONG, LEAST = 2000, 200, 30
#: Share of the usual ratio below which a block is extremely redundant.
REDUNDANT = 0.82
#: Compressed bytes a character of plain prose (medians over prose) by number of
#: characters; between, the logarithm of the number decides.
LENGTHS = (30, 65, 100, 160, 300, 600, 1150, 2000)
PROSE = {"han": (2.27, 2.05, 1.93, 1.81, 1.62, 1.37, 1.12, 0.94), "other": (1.77, 1.37, 1.18, 1.04, 0.88, 0.73, 0.61, 0.50)}
_lengths = [math.log(n) for n in LENGTHS]
_segment = re.compile(r".*?(?:[。！？；!?;]+|\.(?=\s|$))|.+$")
_ended = re.compile(r"(?:[。；;]|[^\d\W]\.|\)\.|\d\.)\s*$")
_lab = re.compile(rf"[-\d.]+\s*(?:{LAB_UNIT})\s*$|^(?:[^\d\n]{{1,20}})[\t |:]+-?\d[\d.]*[\t |]*(?:{LAB_UNIT})")
_drug = re.compile(rf"(?:{DRUG_FORM})(?:[ \t(（,，、xX*×].{{0,30}})?$|(?:{DRUG_FORM})\s*\d+(?:\.\d+)?\s*(?:mg|g|ml|毫克|毫升|克)", re.I)
_url = re.compile(r"(?:https?:)?//[^\s|<>)\]'\"]+|(?<![\w.])(?:[a-z0-9\-]+\.)+(?:com|cn|net|org|test|example|invalid|info|top|xyz|site)\b[^\s|<>)\]'\"]*")
_unit = re.compile("//x+")
_number = re.compile(r"[A-Z]?\d+(?:\.\d+)?")
_heading = re.compile(r"^\s*第[一二三四五六七八九十百\d]+[章节条篇]")
_cjk = re.compile("[一-鿿]")


def usual_ratio(size: int, han: bool) -> float:
    """Compressed bytes a character of plain prose of ``size`` characters."""
    known = PROSE["han" if han else "other"]
    x = math.log(max(size, LENGTHS[0]))
    i = min(bisect.bisect_right(_lengths, x), len(_lengths) - 1)
    a, b = _lengths[i - 1], _lengths[i]
    return max(0.2, known[i - 1] + (known[i] - known[i - 1]) * (x - a) / (b - a))


def redundancy(block: str) -> float:
    """Compression ratio as a share of what prose of that length has; small is redundant."""
    if not block:
        return 1.0
    raw = block.encode("utf-16-le", "surrogatepass")  # all characters of one size
    return len(zlib.compress(raw, 9)) / len(block) / usual_ratio(len(block), bool(_cjk.search(block)))


def masked(text: str) -> str:
    """An address is one unit of its length: its own dots and question marks end no sentence."""
    return _url.sub(lambda m: "//" + "x" * (len(m[0]) - 2), text)


def likened(matter: str) -> str:
    """Addresses are all alike, and numbers are."""
    return _number.sub("0", _unit.sub("//x", matter))


def parted(text: str) -> tuple[int, list[str]]:
    """``(characters in all, loose segments in order)``; a separator counts for each segment."""
    total, loose = 0, []
    for line in text.split("\n"):
        for s in _segment.findall(line):
            if not s.strip():
                continue
            total += len(s) + 1
            if _ended.search(s) and len(s) <= LONG:
                continue
            if not (_lab.search(s) or _drug.search(s.rstrip()) or _heading.search(s)):
                loose.append(s)
    return total, loose


def blocks(loose: list[str]) -> list[list[str]]:
    """Segments in runs of about ``BLOCK`` characters each; a longer segment is cut."""
    pieces = [s[i : i + BLOCK] for s in loose for i in range(0, len(s), BLOCK)]
    size = sum(map(len, pieces))
    most = size / max(1, round(size / BLOCK))
    out: list[list[str]] = []
    room = 0.0
    for s in pieces:
        if room <= 0:
            out.append([])
            room += most
        out[-1].append(s)
        room -= len(s)
    return out


def stuffing(text: str) -> float:
    """Share of the characters of ``text`` that are keyword or link stuffing."""
    total, loose = parted(masked(canon(text)))
    found = 0
    for block in blocks(loose):
        size = sum(len(s) + 1 for s in block)
        if size >= LEAST and redundancy(likened("\n".join(block))) < REDUNDANT:
            found += size
    return min(1.0, found / total) if total else 0.0


def find_stuffed(documents: DataFrame, share: float = 0.7) -> DataFrame:
    """``(doc_id, stuffing)`` of the pages with at least ``share`` stuffing.

    Short blocks are judged mildly, so the measured share errs a little low; the
    default stands for pages of which three quarters are stuffing."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [(d, s) for d, s in ((d, stuffing(t)) for d, t in zip(batch["doc_id"], batch["text"])) if s >= share]
            if hits:
                yield pd.DataFrame(hits, columns=["doc_id", "stuffing"])

    return spread(documents.select("doc_id", "text").where("text is not null")).mapInPandas(scan, "doc_id bigint, stuffing double")
