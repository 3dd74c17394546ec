"""Problem 8: evaluation passages that stand in training texts.

Pigeonhole edit matching: every passage is cut into disjoint pieces of at most
four letters, all documents are searched for the pieces of all passages, and
where enough pieces of a passage hit close by on near diagonals the stretches are
extended and verified with Myers' bit-parallel distance. A document gives a
passage away when at least half of it stands there, in order, in one stretch or
two, each with at most one wrong character in eight (and one more) and at least
one piece untouched.

A wrong character spoils one piece at most, so some pieces stay untouched whatever
the errors in half of the passage (``cut``). Pairs are sorted out by two bounds,
neither of which can lose one: the least number of pieces that the longer stretch
keeps in a window of diagonals and a part of the passage (``dense``), then the
score of a banded alignment in that window (``aligned``). Both work on arrays of
many documents at once; what is left is verified pair by pair.

Texts are compared by their letters, digits and ideographs only, in the one
consistent form and in lower case, so spacing, punctuation, character forms
and case do not count.

The passages are held-out questions, a table that does not grow with the
corpus; they are shipped in blocks of at most ``block`` passages (the documented
bound), more passages mean more scans. Hits per document are bounded by its own
length and never leave its task.

Defined results: null or blank texts and passages under ``least`` letters give
no rows; copies of a passage under several ids are all reported; empty tables
give no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.overlap import within
from docloom.llm.textform import canon
from docloom.session import spread

#: One character in so many may be wrong, and one more in each stretch.
ERRORS = 8
#: Characters by which neighbouring hits of a stretch may be displaced.
DRIFT = 3
#: Most letters of a piece.
WIDEST = 4
#: Documents looked at together hold about so many letters; so many alignments
#: advance together.
LETTERS, TOGETHER = 400_000, 2048
#: A stretch drifts over so many bands of diagonals at most. Bits of a place in a passage.
BANDS, PLACE = 3, 24
#: Scores start here and are set back after so many letters, so that they fit a byte.
FLOOR, REBASE = 8, 64
_skip = re.compile(r"[\W_]+")


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=1)
def _small() -> np.ndarray:
    """The small letter of each code point up to U+FFFF; 0 for what is no letter, digit or ideograph."""
    every = [chr(o) for o in range(0x10000)]
    return np.array([0 if _skip.match(c) else ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every], dtype=np.uint32)


def letters(s: str) -> str:
    """Letters, digits and ideographs only, in the one form and in small letters."""
    codes = _codes(canon(s))
    if len(codes) and codes.max() > 0xFFFF:
        return _skip.sub("", canon(s)).lower()
    small = _small()[codes]
    return small[small > 0].tobytes().decode("utf-32-le", "surrogatepass")


def cut(n: int, share: float) -> tuple[int, int]:
    """``(width, least)``: length of the pieces of a passage of ``n`` letters, and
    how many of them two stretches of ``share`` of it leave untouched at least.

    A stretch of m letters holds (m - 2 (width - 1)) / width whole pieces or more,
    and m / ERRORS + 1 errors at most. Pieces of four letters at most: longer ones
    hit less, but so few of them are sure to be left that common phrases have as many.
    Under about 22 letters nothing is certain at a half."""
    kept = math.ceil(share * n)
    for width in range(WIDEST, 1, -1):
        least = math.ceil((kept - 4 * (width - 1)) / width - kept / ERRORS - 2)
        if least >= 5:
            return width, least
    return 2, 1


def gram_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of ``width`` code points."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = codes[:n] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(1, width):
        h += codes[j : j + n]
        if j < width - 1:
            h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Pieces:
    """Exact look-up of the pieces of one width: where each stands in which passage."""

    def __init__(self, width: int, where: dict[str, list[tuple[int, int]]]):
        self.width = width
        texts = sorted(where)
        self.grams = np.array([gram_hashes(_codes(t).astype(np.uint64), width)[0] for t in texts], dtype=np.uint64)
        self.count = np.array([len(where[t]) for t in texts], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.passage = np.array([n for t in texts for n, _ in where[t]], dtype=np.int32)
        self.at = np.array([at for t in texts for _, at in where[t]], dtype=np.int32)
        bits = max(16, int(len(texts)).bit_length() + 4)
        self.mask = np.uint64((1 << bits) - 1)
        # pieces whose slot is taken go to a further table, until none is left
        self.tables, left = [], np.arange(len(texts), dtype=np.int32)
        while len(left):
            table = np.zeros(1 << bits, dtype=np.int32)
            slot = self._slot(self.grams[left], len(self.tables))
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]

    def _slot(self, h: np.ndarray, level: int) -> np.ndarray:
        return ((h >> np.uint64(level * 11 % 40)) * np.uint64(2 * level + 1) & self.mask).astype(np.int64)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(position, passage, position in the passage)`` of every hit."""
        h = gram_hashes(codes, self.width)
        found = []
        for level, table in enumerate(self.tables):
            piece = table[self._slot(h, level)]
            pos = np.flatnonzero(self.grams[piece] == h)
            piece = piece[pos]
            if level:  # unused slots hold piece 0, which stands in the first table
                pos, piece = pos[piece > 0], piece[piece > 0]
            found.append((pos, piece))
        pos, piece = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        count = self.count[piece]
        which = np.repeat((self.first[piece] - np.cumsum(count) + count).astype(np.int32), count)
        which += np.arange(len(which), dtype=np.int32)
        return np.repeat(pos.astype(np.int32), count), self.passage[which], self.at[which]


class Passages:
    """The pieces of a block of passages and what is needed to verify their hits."""

    def __init__(self, items: list[tuple[int, str]], share: float = 0.5, least: int = 16):
        by_text: dict[str, list[int]] = defaultdict(list)
        for i, context in items:
            k = letters(context or "")
            if len(k) >= least:
                by_text[k].append(i)
        self.keys = sorted(by_text)
        self.ids = [by_text[k] for k in self.keys]
        self.share = share
        self.cut = [cut(len(k), share) for k in self.keys]
        pieces: dict[int, dict[str, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (k, (width, _)) in enumerate(zip(self.keys, self.cut)):
            for at in range(0, len(k) - width + 1, width):
                pieces[width][k[at : at + width]].append((n, at))
        self.pieces = [Pieces(width, where) for width, where in sorted(pieces.items())]
        self.codes = [_codes(k) for k in self.keys]
        self.size = np.array([len(k) for k in self.keys], dtype=np.int64)
        # Halving a stretch leaves one half its share of errors at most, so there is
        # a stretch of m letters, kept / 2 <= m < kept, with m / ERRORS + 1 errors.
        # It drifts by no more, so its hits stand in ``BANDS`` neighbouring bands of
        # diagonals at most; in the more of them, the longer it is.
        kept = np.ceil(share * self.size)
        self.width = width = np.array([c[0] for c in self.cut], dtype=np.int64)
        self.band = -(-(kept // ERRORS + 1).astype(np.int64) // (BANDS - 1))

        def hits_of(m: np.ndarray) -> np.ndarray:
            return np.ceil((m - 2 * (width - 1)) / width - m / ERRORS - 1)

        self.fewest = np.array([c[1] for c in self.cut], dtype=np.int64)
        fewest = np.maximum(1, np.maximum(hits_of(kept / 2), np.ceil(self.fewest / 2)))
        #: Least hits in a window of so many bands.
        self.least = {k: np.maximum(fewest, hits_of((k - 2) * self.band * ERRORS)).astype(np.int64) for k in range(3, BANDS + 1)}
        # h hits of a stretch stand within span[h] letters
        self.most = int(max(1, hits_of(kept).max(initial=1)))
        h = np.arange(self.most + 1)
        self.span = np.maximum(width[:, None], (h + 1 + (2 * (width - 1) / width)[:, None]) / (1 / width - 1 / ERRORS)[:, None])
        self.score = np.maximum(1, np.ceil((1 - 2 / ERRORS) * kept / 2 - 2)).astype(np.int64)
        # letters by their number in the passages, others have none
        # (the rare ones beyond U+FFFE share one: a bound may err to the larger side)
        self.number = np.ones(0x10000, dtype=np.uint16)
        alphabet = np.unique(np.minimum(np.concatenate([np.zeros(0, dtype=np.uint32), *self.codes]), 0xFFFF))
        self.number[alphabet] = np.arange(2, len(alphabet) + 2) % 0x10000

    def candidates(self, docs: list[str], whole: bool = True) -> list[tuple[int, int, list[tuple[int, int]], list[tuple[int, int]]]]:
        """``(document, passage, hits, hits that are alone)`` of the pairs that two bounds leave: hits of
        the longer stretch close by on near diagonals, and its banded alignment."""
        size = np.array([len(d) for d in docs], dtype=np.int64)
        start = np.cumsum(size + 1) - size - 1
        codes = _codes("\0".join(docs) + "\0")
        doc_of = np.repeat(np.arange(len(docs), dtype=np.int32), size + 1)
        wide = codes.astype(np.uint64)
        parts = [p.hits(wide) for p in self.pieces]
        pos, passage, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if not len(pos):
            return []
        pair = doc_of[pos].astype(np.int64) * len(self.keys) + passage
        # fewer hits than two stretches keep in all need no second look
        enough = np.bincount(pair, minlength=len(docs) * len(self.keys)).reshape(len(docs), -1) >= (self.fewest if whole else self.least[3])
        some = np.flatnonzero(enough.ravel()[pair])
        pos, passage, at, pair = pos[some], passage[some], at[some], pair[some]
        if not len(pos):
            return []
        pos -= start.astype(np.int32)[doc_of[pos]]
        rooms = ((size[:, None] + self.size) // self.band + BANDS + 1).ravel()
        base = np.cumsum(rooms) - rooms
        small = [x.astype(np.int32) for x in (self.size, self.band)]
        cell = base[pair] + (pos - at + small[0][passage]) // small[1][passage]
        number = self.number[np.minimum(codes, 0xFFFF)]
        hits = np.sort(cell << PLACE | at)
        of = hits >> PLACE
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
        cells = of[first]
        pair_of = np.searchsorted(base, cells, side="right") - 1
        kept = []
        for bands in self.least:
            at_cell = self.dense(hits, first, cells, pair_of % len(self.keys), bands)
            n_pair = pair_of[at_cell]
            n_doc, n = n_pair // len(self.keys), n_pair % len(self.keys)
            diagonal = (cells[at_cell] - base[n_pair]) * self.band[n] - self.size[n]
            kept.append(n_pair[self.aligned(number, start[n_doc], n, diagonal, bands)])
        kept = np.unique(np.concatenate(kept))
        wanted = np.zeros(len(docs) * len(self.keys), dtype=bool)
        wanted[kept] = True
        mine = np.flatnonzero(wanted[pair])
        pair, pos, at = pair[mine], pos[mine], at[mine]
        # a hit with no other on diagonals as near as neighbours of a stretch may be is
        # a run of its own
        order = np.lexsort((pos - at, pair))
        apart = np.diff(pos[order] - at[order]) > DRIFT
        apart |= pair[order][1:] != pair[order][:-1]
        alone = np.zeros(len(order), dtype=bool)
        alone[order] = np.r_[True, apart] & np.r_[apart, True]
        out = []
        found = []
        for some in (np.flatnonzero(~alone), np.flatnonzero(alone)):
            some = some[np.lexsort((at[some], pos[some], pair[some]))]
            ends = np.searchsorted(pair[some], kept, side="right")
            d, c = pos[some].tolist(), at[some].tolist()
            found.append([(d[a:b], c[a:b]) for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())])
        for p, together, single in zip(kept.tolist(), *found):
            out.append((p // len(self.keys), p % len(self.keys), list(zip(*together)), list(zip(*single))))
        return out

    def dense(self, hits: np.ndarray, first: np.ndarray, cells: np.ndarray, n: np.ndarray, bands: int) -> np.ndarray:
        """Which of the ``cells`` begin a window of so many ``bands`` that holds as many
        distinct pieces, in as short a part of the passage, as a stretch must.

        ``hits`` are sorted cells with the place in the passage in the last bits,
        ``first`` the first hit of each cell, ``n`` its passage."""
        ends = np.r_[first[1:], len(hits)]
        last = ends.copy()  # end of the hits in the window of each
        for step in range(1, min(bands, len(cells))):
            near = np.flatnonzero(cells[step:] < cells[: len(cells) - step] + bands)
            last[near] = ends[near + step]
        count = last - first
        good = np.flatnonzero(count >= self.least[bands][n])
        n, first, count = n[good], first[good], count[good]
        window = np.repeat(np.arange(len(good)), count)
        which = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        keys = np.sort(window << PLACE | hits[which] & ((1 << PLACE) - 1))
        keys = keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]
        window, at = keys >> PLACE, keys & ((1 << PLACE) - 1)
        fits = np.zeros(len(good), dtype=bool)
        for h in range(int(self.least[bands][n].min(initial=self.most)), self.most + 1):
            if len(window) < h:
                break
            i = np.flatnonzero(window[: len(window) - h + 1] == window[h - 1 :])
            m = n[window[i]]
            near = (h >= self.least[bands][m]) & (at[i + h - 1] - at[i] + self.width[m] <= self.span[m, h])
            fits[window[i[near]]] = True
        return good[fits]

    def aligned(self, number: np.ndarray, start: np.ndarray, n: np.ndarray, first: np.ndarray, bands: int) -> np.ndarray:
        """Whether a local alignment (+1 a letter, -2 an error) of each passage within
        a window of diagonals from ``first`` on reaches the score that a stretch
        of m letters has at least, m - 2 (m / ERRORS + 1).

        The alignments of many pairs advance together, letter by letter. Kept is
        half of the score plus the letters read: a letter gives 1, a wrong or missing
        one 0, one put in -1, more put in -2; rounding errs to the larger side."""
        reached = np.zeros(len(n), dtype=bool)
        order = np.argsort(self.size[n], kind="stable")
        for at in range(0, len(order), TOGETHER):
            rows = order[at : at + TOGETHER]
            passages, which = np.unique(n[rows], return_inverse=True)
            longest, wide = int(self.size[passages].max()), int(bands * self.band[passages].max())
            goal = (self.score[n[rows]] + 1) // 2 + FLOOR
            kind = np.uint8 if goal.max() + 2 * REBASE < 256 else np.int32
            keys = np.zeros((longest, len(passages)), dtype=np.uint16)
            for i, m in enumerate(passages.tolist()):
                keys[: self.size[m], i] = self.number[np.minimum(self.codes[m], 0xFFFF)]
            # beyond its ends a document's neighbours are read, which may only raise a score
            there = (start[rows] + first[rows]).astype(np.int32) + np.arange(longest + wide, dtype=np.int32)[:, None]
            text = np.take(number, there, mode="clip")
            score = np.full((wide, len(rows)), FLOOR, dtype=kind)
            spare, key = np.empty_like(score[1:]), np.empty(len(rows), dtype=np.uint16)
            hit, reach = np.zeros((wide, len(rows)), dtype=bool), np.empty((wide, len(rows)), dtype=bool)
            for c in range(longest):
                np.take(keys[c], which, out=key)
                step = score + (text[c : c + wide] == key).view(np.uint8)
                np.maximum(step[:-1], score[1:], out=step[:-1])  # a letter of the passage left out
                np.maximum(step, np.maximum(kind(FLOOR + c % REBASE // 2 + 1), step.max(axis=0) - kind(2)), out=step)
                np.subtract(step[:-1], kind(1), out=spare)
                np.maximum(step[1:], spare, out=step[1:])
                score = step
                if c % 2 or c == longest - 1:
                    enough = (goal + c % REBASE // 2).astype(kind)
                    np.greater_equal(score, enough, out=reach)
                    hit |= reach
                if c % REBASE == REBASE - 1:
                    np.minimum(score, enough, out=score)
                    score -= kind(REBASE // 2)
            reached[rows] = hit.any(axis=0)
        return reached

    def coverage(self, doc: str, n: int, hits: list[tuple[int, int]], alone: list[tuple[int, int]] = []) -> float:
        """Share of passage ``n`` that stands in ``doc`` in at most two stretches;
        0 where that is less than ``share``. ``hits`` are in order; those ``alone`` join no run."""
        key = self.keys[n]
        width = self.cut[n][0]
        open_runs: dict[int, list[tuple[int, int]]] = {}  # by the diagonal of the last hit
        runs = []
        for d, c in hits:
            best = None
            for g in range(d - c - DRIFT, d - c + DRIFT + 1):
                if g in open_runs:
                    x, y = open_runs[g][-1]
                    if x + width <= d and y + width <= c and (best is None or (x, -abs(g - d + c)) > best[0]):
                        best = (x, -abs(g - d + c)), g
            if best is None:
                runs.append(run := [])
            else:
                run = open_runs.pop(best[1])
            run.append((d, c))
            open_runs[d - c] = run
        solid, longest, needed = [], 0, self.share * len(key)
        bounds = sorted(((_longest(run, width), run) for run in runs), reverse=True)
        for bound, run in chain(bounds, ((_longest([hit], width), [hit]) for hit in alone)):
            if max(longest, bound) + bound < needed:
                break
            for s in _stretches(key, doc, run, width, int(bound / ERRORS) + 1):
                solid.append(s)
                longest = max(longest, s[1] - s[0])
        if not solid:
            return 0.0
        most = longest
        for i, (a, b, x, y) in enumerate(solid):
            for a2, b2, x2, y2 in solid[:i] + solid[i + 1 :]:
                # the second stretch begins after the first, in both texts
                if a2 >= b - 2 and x2 >= y - 2:
                    most = max(most, b - a + b2 - max(a2, b))
        return most / len(key)

    def found(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """``(place in texts, item_id, share)`` of the passages that texts give away."""
        out: list[tuple[int, int, float]] = []
        if not self.keys:
            return out
        docs = [letters(t) for t in texts]
        for first, last in _batches([len(d) for d in docs]):
            one = docs[first]
            for d, n, *hits in self.candidates(docs[first:last]) if len(one) <= 2 * LETTERS else self.of_long(one):
                share = self.coverage(docs[first + d], n, *hits)
                if share >= self.share:
                    out += [(first + d, i, share) for i in self.ids[n]]
        return out

    def of_long(self, doc: str) -> list[tuple[int, int, list[tuple[int, int]], list[tuple[int, int]]]]:
        """:meth:`candidates` of one very long document, in parts: its passages are told from
        parts that overlap by more than a stretch, their hits are then taken from all of it."""
        more = 2 * int(self.size.max())
        parts = range(0, len(doc), LETTERS)
        able = np.zeros(len(self.keys), dtype=bool)
        for a in parts:
            able[[n for _, n, *_ in self.candidates([doc[a : a + LETTERS + more]], whole=False)]] = True
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a in parts:
            for p in self.pieces:
                pos, passage, at = p.hits(_codes(doc[a : a + LETTERS + p.width - 1]).astype(np.uint64))
                mine = np.flatnonzero(able[passage])
                for d, n, c in zip((pos[mine] + a).tolist(), passage[mine].tolist(), at[mine].tolist()):
                    hits[n].append((d, c))
        return [(0, n, sorted(h), []) for n, h in hits.items()]


def _batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``LETTERS`` letters together."""
    first, letters_so_far = 0, 0
    for i, n in enumerate(sizes):
        if i > first and letters_so_far + n > LETTERS:
            yield first, i
            first, letters_so_far = i, 0
        letters_so_far += n
    if first < len(sizes):
        yield first, len(sizes)


def _allowed(n: int) -> int:
    return n // ERRORS + 1


def _longest(run: list[tuple[int, int]], width: int) -> float:
    """No stretch over hits of a run is longer than this, errors included."""

    def bound(hits: int) -> float:
        return (hits + 1 + 2 * (width - 1) / width) / (1 / width - 1 / ERRORS)

    most = 1
    for i in range(len(run) - 1):
        for j in range(i + most, len(run)):
            # the pieces between that did not hit are an error each
            if (run[j][1] - run[i][1]) // width - (j - i) <= bound(j - i + 1) / ERRORS + 1:
                most = j - i + 1
    return bound(most)


def _stretches(key: str, doc: str, run: list[tuple[int, int]], width: int, errors: int) -> list[tuple[int, int, int, int]]:
    """``(passage from, to, document from, to)`` of the longest stretches between
    hits of a run that keep to the errors allowed, none within another; none has
    more than ``errors``."""
    cost = [0]  # errors up to each hit
    for (d, c), (d2, c2) in zip(run, run[1:]):
        sure = max((c2 - c) // width - 1, abs(d2 - c2 - d + c))  # pieces that did not hit, displacement
        wrong = within(key[c + width : c2], doc[d + width : d2], errors) if sure <= errors else errors + 1
        cost.append(cost[-1] + (wrong if wrong <= errors else len(key)))
    out, last = [], -1
    for i, (d, c) in enumerate(run):
        j = next(j for j in range(len(run) - 1, i - 1, -1) if cost[j] - cost[i] <= _allowed(run[j][1] + width - c))
        if j <= last:
            continue
        last = j
        bare = (c, run[j][1] + width, d, run[j][0] + width)
        a, b, x, y = _extend(key, doc, *bare)
        out.append((a, b, x, y) if within(key[a:b], doc[x:y], _allowed(b - a)) <= _allowed(b - a) else bare)
    return out


def _extend(key: str, doc: str, a: int, b: int, x: int, y: int) -> tuple[int, int, int, int]:
    """Stretch both ends over equal letters, letting single wrong ones pass."""
    while b < len(key) and y < len(doc):
        if key[b] == doc[y]:
            b, y = b + 1, y + 1
            continue
        step = next((s for s in ((1, 1), (1, 0), (0, 1)) if key[b + s[0] : b + s[0] + 3] == doc[y + s[1] : y + s[1] + 3] != ""), None)
        if step is None or len(key) - b - step[0] < 3:
            break
        b, y = b + step[0], y + step[1]
    while a > 0 and x > 0:
        if key[a - 1] == doc[x - 1]:
            a, x = a - 1, x - 1
            continue
        step = next((s for s in ((1, 1), (1, 0), (0, 1)) if a - s[0] >= 3 and x - s[1] >= 3 and key[a - s[0] - 3 : a - s[0]] == doc[x - s[1] - 3 : x - s[1]]), None)
        if step is None:
            break
        a, x = a - step[0], x - step[1]
    return a, b, x, y


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, block: int = 20_000) -> DataFrame:
    """``(doc_id, item_id, share)`` of every document and the passages it gives away.

    ``documents`` has ``doc_id`` and ``text``; ``items`` has ``item_id`` and ``context``."""
    held = items.select("item_id", "context").where("context is not null")
    size = held.count()
    blocks = max(1, -(-size // block))
    docs = spread(documents.select("doc_id", "text").where("text is not null"))
    found = None
    for b in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod("item_id", F.lit(blocks)) == b)
        rows = [(r["item_id"], r["context"]) for r in part.collect()]  # at most about ``block`` passages

        def scan(batches: Iterator[pd.DataFrame], rows=rows) -> Iterator[pd.DataFrame]:
            passages = Passages(rows, share)
            for batch in batches:
                ids = batch["doc_id"].tolist()
                hits = [(ids[d], i, s) for d, i, s in passages.found(batch["text"].tolist())]
                if hits:
                    yield pd.DataFrame(hits, columns=["doc_id", "item_id", "share"])

        one = docs.mapInPandas(scan, "doc_id bigint, item_id bigint, share double")
        found = one if found is None else found.unionByName(one)
    return found
