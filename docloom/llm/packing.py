"""Problem 7: filling fixed-capacity containers with items.

Harmonic packing. A document of more than the capacity is cut into full pieces and
a rest; no other document is cut. Lengths are partitioned into reciprocal-capacity
classes: class j holds the lengths in (C/(j+1), C/j], of which exactly j fit a bin
whatever they are; all below C/``classes`` are one last class of small items. Workers
fill independent shards of bounded size. In a shard the classes are taken from the
largest lengths down, and every bin of class j gets exactly j items of the class, the
last one of a class what is left of it.

Bins of one class each leave room over (a sixth on the given documents). With
``top_up`` (the default, as the room left over shall be as small as possible) a bin that has
its class's items is filled up at once with items of smaller classes, each time the
longest one that still fits; these are taken out of their class before its own bins
are filled. Without it bins are pure in class.

Only ids and lengths are shuffled, never texts.

Defined results: every document comes out; null and empty texts have no tokens
and stand in no bin (``bin_id`` null); ``size_class`` is the class of the item,
``bin_class`` the one whose items the bin was opened for; the result depends on ids and
lengths only, not on partitioning; repeated rows keep their own ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_ITEMS = 20_000
#: Lengths under a capacity's share of this number are one class.
CLASSES = 64


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a ``.tiktoken`` vocabulary file, loaded once a worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)``; null texts have 0."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    docs = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return spread(docs).mapInPandas(scan, "doc_id bigint, n_tokens bigint")


def size_class(n: int, capacity: int, classes: int) -> int:
    """j for lengths in (C/(j+1), C/j], at most ``classes``."""
    return min(capacity // n, classes)


def pack_lengths(lengths: list[int], capacity: int, classes: int = CLASSES, top_up: bool = True) -> list[tuple[int, int, int]]:
    """``(bin, slot, class of the bin)`` of each length (all between 1 and the capacity)."""
    by_class: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i), reverse=True):
        by_class.setdefault(size_class(lengths[i], capacity, classes), []).append(i)  # longest last
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # items by length
    mask = 0  # lengths of which an item waits
    for j, items in by_class.items():
        for i in items:
            waiting[lengths[i]].append(i)
            mask |= 1 << lengths[i]

    def longest(most: int) -> int:
        """The first item of the longest length up to ``most`` that waits, taken out; -1 if none."""
        nonlocal mask
        n = (mask & ((2 << most) - 1)).bit_length() - 1
        if n <= 0:
            return -1
        i = waiting[n].pop()
        if not waiting[n]:
            mask &= ~(1 << n)
        return i

    placed, bins = [(0, 0, 0)] * len(lengths), 0
    for j in sorted(by_class):
        least = capacity // (j + 1) + 1 if j < classes else 1
        left = sum(len(waiting[n]) for n in range(least, capacity // j + 1))
        while left:
            room, filled = capacity, 0
            # the last class is filled by length, the others by their fixed number
            while left and (filled < j or j == classes):
                i = longest(min(room, capacity // j))
                if i < 0 or lengths[i] < least:
                    break
                placed[i] = (bins, filled, j)
                room, filled, left = room - lengths[i], filled + 1, left - 1
            while top_up and room and (i := longest(min(room, least - 1))) >= 0:
                placed[i] = (bins, filled, j)
                room, filled = room - lengths[i], filled + 1
            bins += 1
    return placed


def pack(counted: DataFrame, capacity: int = 2048, shard_items: int = SHARD_ITEMS, classes: int = CLASSES, top_up: bool = True) -> DataFrame:
    """``(bin_id, slot, doc_id, piece, start_token, n_tokens, size_class, bin_class)``.

    ``counted`` has ``doc_id`` and ``n_tokens``. A piece of full capacity is a
    bin of its own; all others are packed shard by shard."""
    counted = cut_lineage(counted)  # ids and lengths only; texts are read once
    total = counted.count()
    shards = max(1, -(-total // shard_items))
    n = F.col("n_tokens")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(capacity).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    pieces = counted.select("doc_id", "n_tokens", F.posexplode(starts).alias("piece", "start_token"))
    pieces = pieces.withColumn("n_tokens", F.least(n - F.col("start_token"), F.lit(capacity).cast("bigint")))
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("bigint")
    pieces = pieces.withColumn("shard", shard).withColumn("size_class", F.when(n > 0, F.least(F.floor(F.lit(capacity) / n), F.lit(classes).cast("bigint"))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        placed = pack_lengths(pdf["n_tokens"].tolist(), capacity, classes, top_up)
        first = int(pdf["shard"].iloc[0]) << 32
        pdf = pdf.assign(bin_id=[first + b for b, _, _ in placed], slot=[s for _, s, _ in placed], bin_class=[c for _, _, c in placed])
        return pdf[["bin_id", "slot", "doc_id", "piece", "start_token", "n_tokens", "size_class", "bin_class"]]

    schema = "bin_id bigint, slot int, doc_id bigint, piece int, start_token bigint, n_tokens bigint, size_class bigint, bin_class bigint"
    packed = pieces.where(n > 0).groupBy("shard").applyInPandas(one, schema)
    empty = pieces.where(n == 0).select(
        F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("int").alias("slot"), "doc_id", "piece", "start_token", "n_tokens", "size_class",
        F.lit(None).cast("bigint").alias("bin_class"),
    )
    return packed.unionByName(empty)


def packed_sequences(documents: DataFrame, packed: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(bin_id, doc_ids, tokens)``: the training sequences themselves; a bin
    never holds more than its capacity, so its group is bounded."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for b in batches:
            rows = []
            for doc, text, parts in zip(b["doc_id"], b["text"], b["parts"]):
                ids = enc.encode_ordinary(text)
                rows += [(p["bin_id"], p["slot"], doc, ids[p["start_token"] : p["start_token"] + p["n_tokens"]]) for p in parts]
            yield pd.DataFrame(rows, columns=["bin_id", "slot", "doc_id", "tokens"])

    parts = packed.where("bin_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct("bin_id", "slot", "start_token", "n_tokens")).alias("parts"))
    cut = documents.select("doc_id", "text").join(parts, "doc_id").mapInPandas(scan, "bin_id bigint, slot int, doc_id bigint, tokens array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("slot", "doc_id", "tokens")))
    return cut.groupBy("bin_id").agg(ordered.alias("__p")).select(
        "bin_id", F.transform("__p", lambda p: p["doc_id"]).alias("doc_ids"), F.flatten(F.transform("__p", lambda p: p["tokens"])).alias("tokens")
    )
