"""Dataset preparation: splits, truncation, feature arrays, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import arrays

# --- fixed values: ids of the marks around a sequence -------------------------
CLS, SEP, PAD = 101, 102, 0
PAD_LABEL = -100


def bucket(key: Column, seed: int = 0, buckets: int = 100) -> Column:
    """A stable bucket of an integer key, the same on any partitioning."""
    return F.pmod(F.pmod(key + seed, F.lit(1_000_003)) * F.lit(2_654_435_761).cast("bigint"), F.lit(buckets)).cast("int")


def split(df: DataFrame, key: str, test: int = 30, dev_of_test: int = 30, seed: int = 0) -> DataFrame:
    """Adds ``split``: ``test`` percent are held out, of which ``dev_of_test``
    percent are dev (70 / 21 / 9 by default)."""
    b = bucket(F.col(key), seed)
    return df.withColumn("split", F.when(b >= test, "train").when(b < F.lit(test * dev_of_test // 100), "dev").otherwise("test"))


def split_shares(df: DataFrame, key: str, test: int = 10, dev: int = 10, seed: int = 0) -> DataFrame:
    """Adds ``split`` with the given percentages for test and dev (80 / 10 / 10)."""
    b = bucket(F.col(key), seed)
    return df.withColumn("split", F.when(b < test, "test").when(b < test + dev, "dev").otherwise("train"))


def sampled(df: DataFrame, key: str, percent: int, seed: int = 0) -> DataFrame:
    """A sample by key that is the same on any partitioning."""
    return df.where(bucket(F.col(key), seed) < percent)


def batches(df: DataFrame, group: str, order: str, size: int, span: int = 65_536) -> DataFrame:
    """Adds ``batch``: consecutive rows of a group in batches of ``size``, the last
    may be short.

    ``order`` is an integer column, unique within a group. Rows are numbered
    within stretches of ``span`` keys and moved on by the counts of the
    stretches before, so no task ever holds a whole group."""
    cut = F.floor(F.col(order) / F.lit(span))
    d = df.withColumn("__cut", cut)
    before = Window.partitionBy(group).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(group, "__cut").agg(F.count("*").alias("__n")).withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select(F.col(group).alias("__g"), F.col("__cut").alias("__c"), "__off")
    number = F.col("__off") + F.row_number().over(Window.partitionBy(group, "__cut").orderBy(order)) - 1
    joined = d.join(counts, F.col(group).eqNullSafe(F.col("__g")) & F.col("__cut").eqNullSafe(F.col("__c")))
    return joined.select(*df.columns, F.floor(number / F.lit(size)).cast("int").alias("batch"))


def truncated(tokens: Column, max_len: int, keep: str = "pre") -> Column:
    """The first (``pre``) or last (``post``) ``max_len - 2`` tokens."""
    return arrays.cut_front(tokens, max_len - 2) if keep == "pre" else arrays.cut_back(tokens, max_len - 2)


def wrapped(tokens: Column) -> Column:
    """Between the marks of beginning and end."""
    return F.concat(F.array(F.lit("[CLS]")), tokens, F.array(F.lit("[SEP]")))


def features(ids: Column, labels: Column, size: int, left: bool = False, marks: int = 2) -> dict[str, Column]:
    """Fixed-length ``input_ids, input_mask, segment_ids, label_ids, input_len``.

    Sequences are cut to ``size`` less the ``marks`` (3 where a second mark of the end
    follows the first), wrapped, and padded on the right (or left)."""
    ends = marks - 1
    body = F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, size - marks), F.array(*[F.lit(SEP)] * ends))
    tags = F.concat(F.array(F.lit(PAD_LABEL)), F.slice(labels, 1, size - marks), F.array(*[F.lit(PAD_LABEL)] * ends))
    return {
        "input_ids": arrays.padded(body, size, PAD, left), "input_mask": arrays.padded(F.transform(body, lambda x: F.lit(1)), size, 0, left),
        "segment_ids": F.array_repeat(F.lit(0), size), "label_ids": arrays.padded(tags, size, PAD_LABEL, left), "input_len": F.size(body),
    }


def first_piece_labels(words: DataFrame) -> DataFrame:
    """``(doc_id, pos, piece_pos, piece, label_id)``: a word's label on its first
    piece, the pad label on the others; a word without pieces gets ``[unused1]``.

    ``words`` has ``doc_id, pos, pieces, label_id``."""
    some = F.when(F.size("pieces") > 0, F.col("pieces")).otherwise(F.array(F.lit("[unused1]")))
    p = words.select("doc_id", "pos", "label_id", F.posexplode(some).alias("piece_pos", "piece"))
    return p.withColumn("label_id", F.when(F.col("piece_pos") == 0, F.col("label_id")).otherwise(F.lit(PAD_LABEL)))


def question_features(query: Column, tokens: Column, start: Column, size: Column, max_seq: int, longest_query: int = 64) -> dict[str, Column]:
    """Layout of one question chunk: ``[CLS] query [SEP] chunk [SEP]`` with segment
    ids (0, then 1) and a mask of 1 where an answer may stand (the mark of
    beginning and the chunk)."""
    q = F.slice(query, 1, longest_query)
    c = F.slice(tokens, start + 1, size)
    zero, one = F.lit(0), F.lit(1)

    def flat(a, b, d, e, f):
        return F.concat(F.array(a), F.transform(q, lambda x: b), F.array(d), F.transform(c, lambda x: e), F.array(f))

    layout = F.concat(F.array(F.lit("[CLS]")), q, F.array(F.lit("[SEP]")), c, F.array(F.lit("[SEP]")))
    return {
        "layout": layout, "segment_ids": arrays.padded(flat(zero, zero, zero, one, one), max_seq, 0),
        "span_mask": arrays.padded(flat(one, zero, zero, one, zero), max_seq, 0), "input_mask": arrays.padded(F.transform(layout, lambda x: one), max_seq, 0),
    }


def question_targets(query: Column, start: Column, size: Column, first: Column, last: Column, answered: Column, longest_query: int = 64) -> Column:
    """What a chunk is trained on: ``(start_position, end_position, no_answer)``, null for a
    chunk that is thrown out.

    ``first`` and ``last`` are the answer's tokens in the whole text, the chunk holds
    ``size`` tokens from ``start``. A chunk of an answered question that does not hold the
    whole answer is thrown out; one of an unanswered question has placeholders."""
    offset = F.least(F.size(query), F.lit(longest_query)) + 2 - start
    inside = (first >= start) & (last <= start + size - 1)
    found = F.struct((first + offset).alias("start_position"), (last + offset).alias("end_position"), F.lit(0).alias("no_answer"))
    none = F.struct(F.lit(2).alias("start_position"), F.lit(5).alias("end_position"), F.lit(1).alias("no_answer"))
    return F.when(~answered, none).when(inside, found)


def numbered(df: DataFrame, name: str, n: int | None = None) -> DataFrame:
    """In order of the first number in ``name`` (none is last), then of the name; the first
    ``n`` if given."""
    ordered = df.orderBy(F.expr(f"try_cast(regexp_extract({name}, '([0-9]+)', 1) as decimal(38,0))").asc_nulls_last(), name)
    return ordered if n is None else ordered.limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds ``place``: a random-looking order by key that is the same on any partitioning.
    Beyond a million rows places repeat; ``place`` and ``key`` together are the order."""
    return df.withColumn("place", bucket(F.col(key), seed, 1_000_003))


def inherited(files: dict[str, dict[str, dict[str, str]]], name: str) -> dict[str, object]:
    """Experiment parameters of a settings file with its ancestors' values below.

    Sections are ``str_*``, ``int_*`` and ``bool_*`` for the type; ``inherit``
    names the file whose values hold where this one has none."""
    chain, seen = [], set()
    while name and name not in seen:
        seen.add(name)
        chain.append(files[name])
        name = files[name].get("inherit", {}).get("path", "")
    out: dict[str, object] = {}
    kinds = {"str": str, "int": int, "bool": lambda v: str(v).lower() in ("1", "true", "yes", "y", "t")}
    for sections in reversed(chain):
        for section, values in sections.items():
            kind = kinds.get(section.split("_")[0])
            if kind:
                out.update({k: kind(v) for k, v in values.items()})
    return out
