"""Values against lists: containment, token overlap, vectors, reference sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators.blocks import meet


def containment_ratio(
    values: DataFrame, entries: DataFrame, key: str, inside: float = 0.6, around: float = 0.5, never: tuple[str, ...] = ("GATE", "PLEASE")
) -> DataFrame:
    """``(key, value, list_pos, entry)``: the list entry meant by the ``value`` of each
    row, given the ``text`` it comes from.

    An equal entry wins; else the first entry in list order that is contained in
    the value with a length ratio of ``inside``, or contains the value with a
    ratio of ``around`` and stands in the text itself (an entry contained with too
    small a ratio is not tried the other way). Values of up to three characters and
    those with a word of ``never`` mean nothing."""
    some = F.col("value").isNotNull() & (F.length("value") > 3)
    for word in never:
        some &= ~F.contains("value", F.lit(word))
    rows = values.select(key, "value", "text").where(some)
    v = rows.select("value").distinct()
    e = entries.select(F.col("list_pos"), F.col("value").alias("entry")).where("length(entry) >= 3")
    # the shorter text's first three characters stand in the longer one, so the
    # candidates come from an equi-join and nothing is compared with everything
    of = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))).alias("g")
    around_it = v.select("value", of(F.col("value"))).join(e.select("list_pos", "entry", F.substring("entry", 1, 3).alias("g")), "g")
    within_it = v.select("value", F.substring("value", 1, 3).alias("g")).join(e.select("list_pos", "entry", of(F.col("entry"))), "g")
    pairs = around_it.unionByName(within_it).drop("g")
    n, m = F.length("value"), F.length("entry")
    holds = F.contains("value", F.col("entry"))
    fits = (holds & (m / n >= inside)) | (~holds & F.contains(F.col("entry"), F.col("value")) & (n / m >= around))
    # the entries of a value in the order in which they are tried: at most the list
    tried = F.struct((F.col("entry") != F.col("value")).cast("int").alias("other"), "list_pos", "entry", (~holds).alias("in_text"))
    lists = pairs.where(fits).groupBy("value").agg(F.array_sort(F.collect_set(tried)).alias("__tried"))
    found = F.filter("__tried", lambda x: ~x["in_text"] | F.contains(F.coalesce("text", F.lit("")), x["entry"]))
    return rows.join(lists, "value").select(key, "value", F.get(found, F.lit(0)).alias("__e")).where("__e is not null").select(key, "value", "__e.list_pos", "__e.entry")


def overlap_top(queries: DataFrame, dictionary: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, entry_pos, overlap, rank)``: the ``k`` entries that share most
    distinct tokens with each query; of equal overlap later entries come first.

    Both sides are ``(id, tokens)``. Blocks of them meet in tasks, where the postings
    of a query's tokens are counted; a token that stands everywhere costs no more than
    its postings, and only ``k`` entries a query and block are shuffled."""

    def count(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(d):
            entries = d["entry_pos"].to_numpy()
            where: dict[str, list[int]] = {}
            for i, tokens in enumerate(d["tokens"]):
                for t in set(tokens):
                    where.setdefault(t, []).append(i)
            postings = {t: np.array(p) for t, p in where.items()}
            for query, tokens in zip(q["query_id"], q["tokens"]):
                hit = [postings[t] for t in set(tokens) if t in postings]
                if not hit:
                    continue
                shared = np.bincount(np.concatenate(hit), minlength=len(entries))
                some = np.flatnonzero(shared)
                best = some[np.lexsort((-entries[some], -shared[some]))[:k]]
                found.append(pd.DataFrame({"query_id": query, "entry_pos": entries[best], "overlap": shared[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "entry_pos": [], "overlap": []})

    ids = f"query_id {queries.schema['query_id'].dataType.simpleString()}, entry_pos {dictionary.schema['entry_pos'].dataType.simpleString()}, overlap bigint"
    q = queries.select("query_id", "tokens").where("tokens is not null")
    d = dictionary.select("entry_pos", "tokens").where("tokens is not null")
    best = meet(q, d, "query_id", "entry_pos", count, ids)
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("entry_pos"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 4096, rows: int = 65_536) -> DataFrame:
    """``(query_id, vec_id, similarity, rank)``: the ``k`` nearest vectors of each
    query, itself left out, ties by id.

    Blocks of queries and of vectors meet in tasks as one matrix product; only the
    best ``k`` of each query and block are shuffled."""

    def nearest(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        unit = [np.array(list(c), dtype=np.float64) for c in (q["query"], v["embedding"])]
        unit = [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in unit]
        ids, vec = q["query_id"].to_numpy(), v["vec_id"].to_numpy()
        found = []
        for at in range(0, len(ids), 256):
            own = ids[at : at + 256]
            sims = unit[0][at : at + 256] @ unit[1].T
            sims[own[:, None] == vec[None, :]] = -np.inf
            n = min(k, len(vec))
            # ties at the border are kept, the global rank decides
            least = -np.partition(-sims, n - 1, axis=1)[:, n - 1 : n]
            i, j = np.nonzero((sims >= least) & np.isfinite(sims))
            found.append(pd.DataFrame({"query_id": own[i], "vec_id": vec[j], "similarity": sims[i, j]}))
        return pd.concat(found)

    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).where("query is not null")
    v = vectors.select("vec_id", "embedding").where("embedding is not null")
    best = meet(q, v, "query_id", "vec_id", nearest, "query_id bigint, vec_id bigint, similarity double", block, rows)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def absent(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed (null keys stay)."""
    return df.join(listed.select(key).distinct(), key, "left_anti")


def present(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(listed.select(key).distinct(), key, "left_semi")


def low_scored(mentions: DataFrame, boxes: DataFrame, least: float) -> DataFrame:
    """Mentions whose last ``-`` part stands in a box scored below ``least``:
    the first such box by index."""
    part = F.element_at(F.split("value", "-"), -1)
    j = mentions.withColumn("__part", part).join(boxes.select("doc_id", "box_idx", F.col("text").alias("box_text"), "score"), "doc_id")
    j = j.where(F.contains("box_text", F.col("__part")) & (F.col("__part") != ""))
    first = j.groupBy("mention_id").agg(F.min_by("score", "box_idx").alias("score"), F.min("box_idx").alias("box_idx"))
    return first.where(F.col("score") < least)
