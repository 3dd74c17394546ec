"""Problem 5: equal or nearly equal records across splits.

Edit-distance segment join. Copies are folded first: the join runs over distinct
texts, members are attached at the end. Texts of lengths that can agree meet in
blocks. A pair with at most k changes leaves one of k + 1 disjoint segments of the
evaluation text untouched, with no more changes before it than segments and no
more after it (pigeonhole), so the segments of all evaluation texts are looked up
among the substrings of the training texts of the block, at the positions that
this allows. Every hit is kept: no segment, text or pair is left out. What the
counts of characters do not rule out is verified with the dynamic programme of
the edit distance, bit-parallel and stopped beyond the bound.

Only texts are shuffled: a training text once for each 16 million characters of
evaluation texts near its length, an evaluation text once for each group of training
texts of such lengths. Groups are large, as each costs a copy, and are compared in
blocks inside their task; hits and pairs never leave it, and neither texts nor hits
are broadcast.

Defined results: null or short texts (under ``least_words`` non-blank words)
take no part; equal texts have distance 0; a pair is reported once, smaller id
first; an empty side gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.splitting import BLANK
from docloom.llm.textform import LINE_BREAK, canon
from docloom.session import cut_to_files, spread

#: Blocks that are compared at once hold so many texts (of each side) and characters at most.
EVAL_BLOCK, TRAIN_BLOCK, CHARACTERS = 2048, 4096, 1_000_000
#: Training texts whose lengths differ by a factor of ``CLASS`` at most share a class; the
#: groups of a class hold ``SMALLEST`` to ``LARGEST`` characters, about ``PER_CORE`` groups a core in all.
CLASS, SMALLEST, LARGEST, PER_CORE = 1.2, 1_000_000, 16_000_000, 2
#: Bits of a position in a segment's key; pairs looked at together.
PLACE, TOGETHER = 24, 16_384
_FACTORS = np.random.default_rng(20240229).integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)


def comparable(words) -> str:
    """The words strung together in one form, without blanks and line breaks, lower case."""
    s = canon("".join(w for w in words if w and w != LINE_BREAK))
    return "".join(s.split()).lower()


def within(a: str, b: str, k: int) -> int:
    """Edit distance of ``a`` and ``b``, or k+1 if it is more (Myers' bit vectors)."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > k:
        return k + 1
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if not m:
        return n
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for j, c in enumerate(b):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score - (n - 1 - j) > k:
            return k + 1
        ph = (ph << 1 | 1) & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return score


@F.pandas_udf(T.StringType())
def _comparable(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else comparable(w))


def split_of(path, guid):
    """``train``, ``dev`` or ``test`` from ``<task>/<split>.txt``, else from the guid."""
    from_path = F.regexp_extract(F.coalesce(path, F.lit("")), r"(train|dev|test)\.txt$", 1)
    from_guid = F.lower(F.regexp_extract(F.coalesce(guid, F.lit("")), r"^(?i)(train|dev|test)\b", 1))
    return F.when(from_path != "", from_path).when(from_guid != "", from_guid)


def labelled_texts(examples: DataFrame, least_words: int = 10) -> DataFrame:
    """``(example_id, split, source, text)`` of the examples that take part."""
    solid = F.size(F.filter("words", lambda w: ~F.coalesce(w, F.lit("")).rlike(BLANK)))
    e = examples.select("example_id", "guid", "path", "source", "words").where(F.col("words").isNotNull() & (solid >= least_words))
    return spread(e).select("example_id", split_of(F.col("path"), F.col("guid")).alias("split"), "source", _comparable("words").alias("text")).where("split is not null and text <> ''")


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h >> np.uint64(PLACE) << np.uint64(PLACE)


class Block:
    """The texts of one side of a block as one array of characters."""

    def __init__(self, texts: pd.Series):
        self.texts = texts.to_numpy()
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        if len(self.size) and self.size.max() >> PLACE:
            raise ValueError(f"texts of 2^{PLACE} characters and more cannot be compared")
        self.start = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(self.size)), self.size)

    def counts(self, bins: int) -> np.ndarray:
        """How often characters of each residue occur in each text."""
        flat = np.bincount(self.of * bins + (self.codes % np.uint64(bins)).astype(np.int64), minlength=len(self.size) * bins)
        return np.minimum(flat, 30_000).astype(np.int16).reshape(-1, bins)

    def runs(self, text: int, width: int) -> np.ndarray:
        """How often runs of so many characters of each residue occur in one text."""
        codes = self.codes[self.start[text] : self.start[text] + self.size[text]]
        n = max(0, len(codes) - width + 1)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            h += codes[j : j + n] * _FACTORS[j]
        return np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=1 << 12)

    def substrings(self, width: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(key, text)`` of the substrings that may be among the ``wanted`` hashes,
        sorted; a key is the hash of the substring and its position."""
        n = max(0, len(self.codes) - width + 1)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            h += self.codes[j : j + n] * _FACTORS[j % 64]
        h = _mixed(h)
        table = np.zeros(1 << 20, dtype=bool)
        table[(wanted >> np.uint64(44)).astype(np.int64)] = True
        at = np.flatnonzero(table[(h >> np.uint64(44)).astype(np.int64)])
        of = self.of[at]
        place = at - self.start[of]
        whole = place + width <= self.size[of]
        key = (h[at] | place.astype(np.uint64))[whole]
        order = np.argsort(key)
        return key[order], of[whole][order]

    def segments(self, share: int, least: int, most: int) -> dict[int, list[np.ndarray]]:
        """``width: (hash, first position, last position, text)`` of the k + 1 segments
        of every text, where partners are ``least`` to ``most`` characters long.

        Segment i (of 0 to k) that is untouched while those before it all are touched
        has i changes before it at least, and k - i at most after it."""
        out: dict[int, list[list[np.ndarray]]] = {}
        for n in np.unique(self.size).tolist():
            longest = min(most, n * share // (share - 1))
            k = max(n, longest) // share
            shortest = max(least, n - k)
            if longest < shortest:
                continue
            rows = np.flatnonzero(self.size == n)
            cut = np.arange(k + 2) * n // (k + 1)
            order = np.arange(k + 1)
            first = np.maximum(np.maximum(cut[:-1] - order, cut[:-1] + shortest - n - (k - order)), 0)
            last = np.minimum(cut[:-1] + order, cut[:-1] + longest - n + (k - order))
            for width in np.unique(np.diff(cut)).tolist():
                which = np.flatnonzero((np.diff(cut) == width) & (first <= last))
                h = np.zeros((len(rows), len(which)), dtype=np.uint64)
                at = self.start[rows][:, None] + cut[which]
                for j in range(width):
                    h += self.codes[at + j] * _FACTORS[j % 64]
                wide = [np.tile(x[which].astype(np.uint64), len(rows)) for x in (first, last)]
                out.setdefault(width, []).append([_mixed(h).ravel(), *wide, np.repeat(rows, len(which))])
        return {w: [np.concatenate(c) for c in zip(*parts)] for w, parts in out.items()}


def candidates(e: Block, t: Block, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts of two blocks with a segment in common where it may stand."""
    if not len(e.size) or not len(t.size):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = []
    for width, (h, first, last, text) in e.segments(share, int(t.size.min()), int(t.size.max())).items():
        key, of = t.substrings(width, h)
        order = np.argsort(h)  # neighbouring look-ups stay in the cache
        h, first, last, text = h[order], first[order], last[order], text[order]
        a = np.searchsorted(key, h | first)
        count = np.searchsorted(key, h | last, side="right") - a
        some = count > 0
        a, count, text = a[some], count[some], text[some]
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        pairs.append(np.repeat(text, count) * len(t.size) + of[which])
    both = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
    both = both[np.r_[True, both[1:] != both[:-1]][: len(both)]]
    i, j = both // len(t.size), both % len(t.size)
    good = np.abs(e.size[i] - t.size[j]) <= np.maximum(e.size[i], t.size[j]) // share
    return i[good], j[good]


def unlike(e: Block, t: Block, i: np.ndarray, j: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that counts of characters, and of runs of two and three, do not rule
    out: a change alters two counts of characters by one at most, four of pairs and
    six of triples."""
    for bins in (64, 512):
        x, y, kept = e.counts(bins), t.counts(bins), []
        for at in range(0, len(i), TOGETHER):
            a, b = i[at : at + TOGETHER], j[at : at + TOGETHER]
            differ = np.abs(x[a] - y[b]).sum(axis=1, dtype=np.int32)
            kept.append(np.flatnonzero(differ <= 2 * (np.maximum(e.size[a], t.size[b]) // share)) + at)
        good = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
        i, j = i[good], j[good]
    for width in (2, 3):
        k = np.maximum(e.size[i], t.size[j]) // share
        good = np.array([np.abs(e.runs(a, width) - t.runs(b, width)).sum() <= 2 * width * c for a, b, c in zip(i, j, k)], dtype=bool)
        i, j = i[good], j[good]
    return i, j


_NEAR = "rep_eval bigint, rep_train bigint, distance int, longer int"


def _parts(size: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """Runs of texts of about ``rows`` and ``CHARACTERS`` at most."""
    ends, total = [0], np.r_[0, np.cumsum(size)]
    while ends[-1] < len(size):
        a = ends[-1]
        ends.append(min(a + rows, max(a + 1, int(np.searchsorted(total, total[a] + CHARACTERS, side="right")) - 1)))
    return list(zip(ends, ends[1:]))


def _verify_blocks(share: int, rows_e: int, rows_t: int):
    """Kernel that joins a group of evaluation texts with one of training texts, block by block."""

    def run(e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        size_e, size_t = (x.str.len().to_numpy(dtype=np.int64) for x in (e["e_text"], t["t_text"]))
        e, t = e.iloc[np.argsort(size_e, kind="stable")], t.iloc[np.argsort(size_t, kind="stable")]
        size_e, size_t = np.sort(size_e), np.sort(size_t)
        for c, d in _parts(size_t, rows_t):
            right, rep_t = Block(t["t_text"].iloc[c:d]), t["t_rep"].iloc[c:d].to_numpy()
            first = np.searchsorted(size_e * share, size_t[c] * (share - 1))
            last = np.searchsorted(size_e * (share - 1), size_t[d - 1] * share, side="right")
            for a, b in _parts(size_e[first:last], rows_e):
                left, rep_e = Block(e["e_text"].iloc[first + a : first + b]), e["e_rep"].iloc[first + a : first + b].to_numpy()
                for i, j in zip(*unlike(left, right, *candidates(left, right, share), share)):
                    x, y = left.texts[i], right.texts[j]
                    k = max(len(x), len(y)) // share
                    if rep_e[i] != rep_t[j] and (n := within(x, y, k)) <= k:
                        out.append((rep_e[i], rep_t[j], n, max(len(x), len(y))))
        return pd.DataFrame(out, columns=["rep_eval", "rep_train", "distance", "longer"])

    return run


def groups_of(classes: list[tuple], share: int, cores: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(class, least, most, train groups, evaluation groups, number of the first)`` of
    each class with training texts and evaluation texts of lengths that can agree.

    ``classes`` has ``(class, (texts' least and most length, characters) of training, the same of evaluation)``."""
    total = sum(t[2] for _, t, _ in classes if t[2])
    room = min(LARGEST, max(SMALLEST, total // (PER_CORE * cores)))
    out, number = [], 0
    for c, (least, most, characters), _ in sorted(classes):
        near = sum(e[2] for _, _, e in classes if e[2] and e[1] * share >= least * (share - 1) and most * share >= e[0] * (share - 1)) if characters else 0
        if near:
            n_t, n_e = -(-characters // room), -(-near // LARGEST)
            out.append((c, least, most, n_t, n_e, number))
            number += n_t * n_e
    return out


def dealt(texts: DataFrame, share: int = 5) -> tuple[DataFrame, DataFrame, int] | None:
    """``(group, rep, text)`` of the evaluation and of the training texts, prefixed, and the
    number of groups; None where no two lengths can agree."""
    spark = texts.sparkSession
    size = F.length("text")
    texts = texts.withColumn("class", F.floor(F.log(size) / float(np.log(CLASS))).cast("int"))

    def of(side: str) -> list:
        own = F.when(F.col(f"in_{side}"), size)
        return [F.coalesce(f(own).cast("long"), F.lit(0)) for f in (F.min, F.max, F.sum)]

    # one row for each class: lengths up to 2^31 have under 120
    rows = texts.groupBy("class").agg(*of("train"), *of("eval")).collect()
    groups = groups_of([(r[0], tuple(r[1:4]), tuple(r[4:7])) for r in rows], share, spark.sparkContext.defaultParallelism)
    if not groups:
        return None
    names = ("class", "least", "most", "n_t", "n_e", "first")
    table = F.array(*(F.struct(*(F.lit(x).cast("long").alias(n) for n, x in zip(names, g))) for g in groups))
    near = {
        "e": lambda g: (size * share >= g["least"] * (share - 1)) & (g["most"] * share >= size * (share - 1)),
        "t": lambda g: g["class"] == F.col("class"),
    }

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.select("rep", "text", F.explode(F.filter(table, near[own])).alias("g"))
        mine = F.pmod(F.xxhash64("rep"), F.col(f"g.n_{own}"))
        rows = rows.select("rep", "text", "g", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"g.n_{other}") - 1)).alias("its"))
        t, e = ("mine", "its") if own == "t" else ("its", "mine")
        number = F.col("g.first") + F.col(t) * F.col("g.n_e") + F.col(e)
        return rows.select(number.cast("int").alias(f"{own}_group"), F.col("rep").alias(f"{own}_rep"), F.col("text").alias(f"{own}_text"))

    return side(texts.where("in_eval"), "e", "t"), side(texts.where("in_train"), "t", "e"), sum(g[3] * g[4] for g in groups)


def near_texts(texts: DataFrame, share: int = 5) -> DataFrame:
    """``(rep_eval, rep_train, distance, longer)`` of distinct texts, one of each
    side, that need changes in at most one of ``share`` characters of the longer.

    ``texts`` has ``rep`` (unique), ``text``, ``in_train``, ``in_eval``. Every text of
    one side meets every text of the other whose length comes close enough."""
    spark = texts.sparkSession
    sides = dealt(texts, share)
    if sides is None:
        return spark.createDataFrame([], _NEAR)
    left, right, groups = sides
    # few bytes but much work: a stated number of partitions, which Spark does not coalesce by size
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * groups)
    left, right = (x.repartition(parts, f"{own}_group").groupBy(f"{own}_group") for own, x in (("e", left), ("t", right)))
    return left.cogroup(right).applyInPandas(_verify_blocks(share, EVAL_BLOCK, TRAIN_BLOCK), _NEAR)


def overlaps(examples: DataFrame, share: int = 5, least_words: int = 10) -> DataFrame:
    """``(example_train, example_eval, distance, longer, split, source_train, source_eval)``
    for every pair of a training and an evaluation example whose texts agree.

    Copies are told by a 256-bit digest, so that ids are joined without their texts;
    the joins are merge joins, whatever their size is taken for."""
    # read and normalised once: the branches below start from the written rows
    labelled = labelled_texts(examples, least_words).withColumns({"in_train": F.col("split") == "train", "digest": F.unhex(F.sha2("text", 256))})
    labelled = cut_to_files(labelled)
    texts = labelled.groupBy("digest").agg(
        F.min("example_id").alias("rep"), F.max("in_train").alias("in_train"), F.max(~F.col("in_train")).alias("in_eval"), F.any_value("text").alias("text")
    )
    texts = cut_to_files(texts)
    members = labelled.select("digest", "example_id", "split", "source", "in_train").hint("merge").join(texts.select("digest", "rep").hint("merge"), "digest").drop("digest")
    both = texts.where("in_train and in_eval")
    pairs = near_texts(texts, share).unionByName(
        both.select(F.col("rep").alias("rep_eval"), F.col("rep").alias("rep_train"), F.lit(0).alias("distance"), F.length("text").alias("longer"))
    )
    of_eval = members.where("not in_train").select(F.col("rep").alias("rep_eval"), F.col("example_id").alias("example_eval"), "split", F.col("source").alias("source_eval"))
    of_train = members.where("in_train").select(F.col("rep").alias("rep_train"), F.col("example_id").alias("example_train"), F.col("source").alias("source_train"))
    found = pairs.hint("merge").join(of_eval.hint("merge"), "rep_eval")
    return found.hint("merge").join(of_train.hint("merge"), "rep_train").drop("rep_eval", "rep_train")
