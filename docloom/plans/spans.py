"""Queries over chunks, answers, vectors, dictionaries, datasets and streams, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import arrays
from docloom.operators import datasets, match, metrics, scoring, spans
from docloom.plans.payloads import BOXES, listed
from docloom.session import checkpoint_dir, read
from docloom.streaming import pipeline

ROOM, STRIDE, BEST = 60, 25, 5

CHUNKS = f"""
len AS (SELECT item_id, length(context)::INTEGER AS n, context FROM eval_items WHERE context <> ''),
chk AS (SELECT item_id, context, n, unnest(range(CASE WHEN n <= {ROOM} THEN 1 ELSE 1 + CAST(ceil((n - {ROOM}) / {STRIDE}.0) AS BIGINT) END))::INTEGER AS chunk FROM len),
ch AS (SELECT item_id, context, chunk, chunk * {STRIDE} AS start, least({ROOM}, n - chunk * {STRIDE})::INTEGER AS size FROM chk)"""
LOGITS = """
pos AS (SELECT item_id, chunk, context, start, size, unnest(range(size))::INTEGER AS p FROM ch),
lg AS (SELECT *, ((p * 7 + item_id * 3 + chunk * 5) % 23)::DOUBLE AS sl, ((p * 11 + item_id + chunk) % 19)::DOUBLE AS el FROM pos)"""
CANDIDATES = f"""
bs AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY item_id, chunk ORDER BY sl DESC, p) <= {BEST}),
be AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY item_id, chunk ORDER BY el DESC, p) <= {BEST}),
cand AS (SELECT s.item_id AS qas_id, s.chunk, s.p AS s, e.p AS e, s.sl + e.el AS score, substring(s.context, s.start + s.p + 1, e.p - s.p + 1) AS text
  FROM bs s JOIN be e USING (item_id, chunk) WHERE s.p >= 2 AND e.p <= s.size - 2 AND e.p >= s.p AND e.p - s.p + 1 <= 20)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "eval_items").where("context is not null and context <> ''").withColumn("n", F.length("context"))


def chunk_windows(spark, sf_dir):
    return spans.chunks(_items(spark, sf_dir), "item_id", "n", ROOM, STRIDE)


def chunk_windows_examples(spark, sf_dir):
    """Room of 300 and stride of 50 over the words of examples."""
    e = read(spark, sf_dir, "examples").where("words is not null").select("example_id", F.size("words").alias("n"))
    return spans.chunks(e, "example_id", "n", 300, 50)


def max_context(spark, sf_dir):
    return spans.max_context(chunk_windows(spark, sf_dir), "item_id")


def _scored(spark, sf_dir):
    c = chunk_windows(spark, sf_dir).join(_items(spark, sf_dir).select("item_id", "context"), "item_id")
    p = F.sequence(F.lit(0), F.col("size") - 1)
    return c.select(
        F.col("item_id").alias("qas_id"), "chunk", "start", "size", "context",
        F.transform(p, lambda i: ((i * 7 + F.col("item_id") * 3 + F.col("chunk") * 5) % 23).cast("double")).alias("start_logits"),
        F.transform(p, lambda i: ((i * 11 + F.col("item_id") + F.col("chunk")) % 19).cast("double")).alias("end_logits"),
        F.lit(2).alias("first"), (F.col("size") - 2).alias("last"),
    )


def qa_candidates(spark, sf_dir):
    return spans.candidates(_scored(spark, sf_dir), BEST, 20)


def _texts(spark, sf_dir):
    s = _scored(spark, sf_dir)
    c = spans.candidates(s, BEST, 20).join(s.select("qas_id", "chunk", "start", "context"), ["qas_id", "chunk"])
    return c.withColumn("text", F.expr("substring(context, start + s + 1, e - s + 1)")).drop("context", "start")


def qa_nbest(spark, sf_dir):
    return spans.n_best(_texts(spark, sf_dir), 10).select("qas_id", "rank", "chunk", "s", "e", "score", "text")


def qa_nbest_json(spark, sf_dir):
    """The n best of each question as JSON."""
    return spans.n_best_json(qa_nbest(spark, sf_dir))


def qa_vote(spark, sf_dir):
    v = chunk_windows(spark, sf_dir).select(F.col("item_id").alias("qas_id"), (F.col("item_id") * 7 % 5 + F.col("chunk") > 2).cast("bigint").alias("no_answer"))
    return spans.vote(v)


def qa_softmax(spark, sf_dir):
    sm = arrays.softmax(F.col("start_logits"))
    return _scored(spark, sf_dir).select("qas_id", "chunk", F.round(F.array_max(sm), 9).alias("largest"), F.round(arrays.log_sum_exp(F.col("start_logits")), 9).alias("lse"))


def qa_widened(spark, sf_dir):
    b = spans.n_best(_texts(spark, sf_dir), 1).join(_scored(spark, sf_dir).select("qas_id", "chunk", "size"), ["qas_id", "chunk"])
    return b.select("qas_id", *spans.widened(F.col("s"), F.col("e"), F.lit(0), F.col("size") - 1))


def qa_tightest(spark, sf_dir):
    """The answer of each item located in the tokens of its context."""
    i = _items(spark, sf_dir).where("answer is not null and answer <> ''")
    chars = F.filter(F.split("context", ""), lambda x: x != "")
    want = F.filter(F.split("answer", ""), lambda x: x != "")
    t = spans.tightest(chars, want, F.lit(0), F.col("n") - 1)
    return i.select("item_id", t.alias("t")).select("item_id", "t.start", "t.end")


def qa_layout(spark, sf_dir):
    """Fixed-length layout of the question chunks."""
    c = chunk_windows(spark, sf_dir).join(_items(spark, sf_dir).select("item_id", "context", "question"), "item_id")
    q, t = (F.filter(F.split(x, ""), lambda y: y != "") for x in ("question", "context"))
    f = datasets.question_features(q, t, F.col("start"), F.col("size"), 128)
    total = {k: F.aggregate(f[k], F.lit(0), lambda a, v: a + v) for k in ("segment_ids", "span_mask", "input_mask")}
    return c.select("item_id", "chunk", F.size(f["layout"]).alias("used"), *[v.alias(k) for k, v in total.items()])


def qa_flattened(spark, sf_dir):
    """Nested question documents made from the items and flattened again."""
    answer = F.when(F.col("answer").isNotNull(), F.array(F.struct(F.col("answer").alias("text"), F.lit(0).alias("answer_start")))).otherwise(F.array().cast("array<struct<text:string,answer_start:int>>"))
    qas = F.array(F.struct(F.col("item_id").cast("string").alias("id"), "question", answer.alias("answers")))
    para = F.array(F.struct(F.lit("p").alias("id"), "context", qas.alias("qas")))
    data = F.array(F.struct(F.col("item_id").cast("string").alias("id"), F.col("task").alias("title"), para.alias("paragraphs")))
    return spans.questions(read(spark, sf_dir, "eval_items").select(data.alias("data"))).select("doc_id", "qas_id", "question", "answer", "answer_start")


def original_answers(spark, sf_dir):
    """Answers given without blanks and in lower case, as written in the context (no SQL)."""
    i = _items(spark, sf_dir).where("answer is not null")
    bare = F.lower(F.regexp_replace("answer", "\\s", ""))
    return i.select("item_id", spans.original_text()(bare, F.col("context")).alias("text"))


def cosine_topk(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    top = match.cosine_top(v.where("vec_id % 20 = 0"), v)
    return top.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def cosine_pairs(spark, sf_dir):
    """Cosine of each vector with its neighbour by id, as an expression."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(w, "vec_id").select("vec_id", F.round(arrays.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def token_overlap_topk(spark, sf_dir):
    q = read(spark, sf_dir, "mentions").where("category in ('ad_diag', 'dis_diag') and value is not null").select(F.col("mention_id").alias("query_id"), F.filter(F.split("value", ""), lambda x: x != "").alias("tokens"))
    d = read(spark, sf_dir, "eval_items").where("question is not null").select(F.col("item_id").alias("entry_pos"), F.filter(F.split("answer", ""), lambda x: x != "").alias("tokens"))
    return match.overlap_top(q, d)


def hash_split(spark, sf_dir):
    return datasets.split(read(spark, sf_dir, "examples").select("example_id", "path"), "example_id").groupBy("split").agg(F.count("*").alias("n"), F.sum("example_id").alias("ids"))


def hash_split_shares(spark, sf_dir):
    return datasets.split_shares(read(spark, sf_dir, "examples").select("example_id"), "example_id").select("example_id", "split")


def hash_sample(spark, sf_dir):
    """A tenth of the documents by key: sampling is the operator here."""
    return datasets.sampled(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 10, seed=42)


def batched(spark, sf_dir):
    return datasets.batches(read(spark, sf_dir, "mentions").select("mention_id", "category"), "category", "mention_id", 32)


def truncate_pre_post(spark, sf_dir):
    w = F.transform("words", lambda x: F.coalesce(x, F.lit("")))
    e = read(spark, sf_dir, "examples").where("words is not null")
    pre, post = datasets.wrapped(datasets.truncated(w, 128)), datasets.truncated(w, 128, "post")
    return e.select("example_id", F.size(pre).alias("n_pre"), F.md5(F.array_join(pre, "|")).alias("pre"), F.size(post).alias("n_post"), F.md5(F.array_join(post, "|")).alias("post"))


def feature_arrays(spark, sf_dir):
    lab = F.transform("labels", lambda x: F.length(F.coalesce(x, F.lit("O"))).cast("int"))
    ids = F.transform("words", lambda x: (F.length(F.coalesce(x, F.lit(""))) + 1000).cast("int"))
    e = read(spark, sf_dir, "examples").where("words is not null and labels is not null")
    f = datasets.features(ids, lab, 128)
    total = {k: F.aggregate(f[k], F.lit(0).cast("bigint"), lambda a, v: a + v) for k in ("input_ids", "input_mask", "label_ids")}
    return e.select("example_id", F.size(f["input_ids"]).alias("size"), f["input_len"].alias("input_len"), *[v.alias(k) for k, v in total.items()])


def piece_labels(spark, sf_dir):
    """Labels on the first piece of each word, pieces of two characters."""
    t = read(spark, sf_dir, "examples").where("words is not null and labels is not null").select(F.col("example_id").alias("doc_id"), F.posexplode(F.arrays_zip("words", "labels")).alias("pos", "z"))
    w = t.select("doc_id", "pos", F.regexp_extract_all(F.coalesce("z.words", F.lit("")), F.lit("(?s)(..?)"), F.lit(1)).alias("pieces"), F.length(F.coalesce("z.labels", F.lit("O"))).alias("label_id"))
    p = datasets.first_piece_labels(w)
    return p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("label_id").alias("label_sum"), F.count(F.when(F.col("piece") == "[unused1]", 1)).alias("unused"))


def stub_labels(spark, sf_dir):
    """A scorer at work: logits per token and the best label."""
    ids = F.transform("words", lambda x: F.length(F.coalesce(x, F.lit(""))).cast("bigint"))
    e = read(spark, sf_dir, "examples").where("words is not null").select(F.col("example_id").alias("doc_id"), ids.alias("ids"))
    scored = scoring.score_tokens(e, "ids", lambda: scoring.stub_scorer(4))
    return scored.select("doc_id", F.array_join(scoring.best_labels(F.col("logits")), "").alias("labels"))


def viterbi_labels(spark, sf_dir):
    """The best path through the scorer's logits."""
    ids = F.transform("words", lambda x: F.length(F.coalesce(x, F.lit(""))).cast("bigint"))
    e = read(spark, sf_dir, "examples").where("words is not null").select(F.col("example_id").alias("doc_id"), ids.alias("ids"))
    scored = scoring.score_tokens(e, "ids", lambda: scoring.stub_scorer(4))
    return scored.select("doc_id", F.array_join(scoring.viterbi(np.array(STEP_4))(F.col("logits")), "").alias("path"))


def masked_paths(spark, sf_dir):
    """Best paths behind the mark of beginning, up to each text's length."""
    ids = F.transform("words", lambda x: F.length(F.coalesce(x, F.lit(""))).cast("bigint"))
    e = read(spark, sf_dir, "examples").where("words is not null").select(F.col("example_id").alias("doc_id"), ids.alias("ids"))
    scored = scoring.score_tokens(e, "ids", lambda: scoring.stub_scorer(3))
    path = scoring.masked_viterbi(np.array(STEP_3))(F.col("logits"), F.least(F.size("logits"), F.lit(128)))
    return scored.select("doc_id", F.array_join(path, "").alias("path"))


def mean_losses(spark, sf_dir):
    """Mean loss a label, over all texts, without transitions."""
    ids = F.transform("words", lambda x: F.length(F.coalesce(x, F.lit(""))).cast("bigint"))
    e = read(spark, sf_dir, "examples").where("words is not null").select(F.col("example_id").alias("doc_id"), ids.alias("ids"))
    scored = scoring.score_tokens(e, "ids", lambda: scoring.stub_scorer(3))
    labels = F.transform("logits", lambda x: F.when(x[0] > x[1], F.lit(-100)).otherwise(F.lit(1)))
    n = F.greatest(F.size("logits") - 1, F.lit(0))
    loss = scoring.masked_loss(np.zeros((3, 3)))(F.col("logits"), labels, F.size("logits"))
    return metrics.mean_loss(scored.select(loss.alias("loss"), n.alias("steps")), "loss", "steps").select("n", F.round("mean_loss", 6).alias("mean_loss"))


def question_training(spark, sf_dir):
    """Chunks of the held-out passages that a reader is trained on, and their targets."""
    i = read(spark, sf_dir, "eval_items").where("context <> ''").withColumn("answer", F.coalesce("answer", F.lit("")))
    at = F.instr("context", F.col("answer")) - 1
    i = i.where((F.col("answer") == "") | (at >= 0)).select("item_id", "question", "context", "answer", at.alias("first"), (at + F.length("answer") - 1).alias("last"))
    c = chunk_windows(spark, sf_dir).join(i, "item_id")
    t = datasets.question_targets(F.split("question", ""), F.col("start"), F.col("size"), F.col("first"), F.col("last"), F.col("answer") != "")
    return c.select("item_id", "chunk", t.alias("t")).where("t is not null").select("item_id", "chunk", "t.*")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_codes(spark, sf_dir):
    """The stateless path on a stream of payload files, exactly once."""
    path, like = f"{sf_dir}/ocr_raw.parquet", read(spark, sf_dir, "ocr_raw")
    out = _folder(spark, "codes")
    pipeline.run(pipeline.codes(pipeline.read_stream(spark, path, like)), out, out + "-log")
    return spark.read.parquet(out).groupBy("code").agg(F.count("*").alias("responses"), F.sum("n_elements").alias("elements"))


def stream_hourly(spark, sf_dir):
    """Windowed counts of a stream behind a watermark."""
    path = f"{sf_dir}/events.parquet"
    stream = pipeline.read_stream(spark, path, read(spark, sf_dir, "events"))
    out = _folder(spark, "hourly")
    pipeline.run_whole(pipeline.hourly(stream.withColumn("ts", F.col("ts").cast("timestamp"))), out, out + "-log")
    return spark.read.parquet(out).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_once(spark, sf_dir):
    """Documents of a stream of deliveries, repeated ones dropped within the watermark."""
    path, like = f"{sf_dir}/ocr_raw.parquet", read(spark, sf_dir, "ocr_raw")
    stream = pipeline.read_stream(spark, path, like).withColumn("received_at", F.col("received_at").cast("timestamp")).where("received_at is not null")
    out = _folder(spark, "once")
    pipeline.run(pipeline.once(stream, ["doc_id"]).select("doc_id"), out, out + "-log")
    return spark.read.parquet(out)


def stream_box_texts(spark, sf_dir):
    """Canonical texts of the boxes on a stream of payloads."""
    path, like = f"{sf_dir}/ocr_raw.parquet", read(spark, sf_dir, "ocr_raw")
    out = _folder(spark, "boxes")
    pipeline.run(pipeline.box_texts(pipeline.read_stream(spark, path, like)), out, out + "-log")
    return spark.read.parquet(out)


QUERIES = {
    f.__name__: f
    for f in (
        chunk_windows, chunk_windows_examples, max_context, qa_candidates, qa_nbest, qa_nbest_json, qa_vote, qa_softmax, qa_widened, qa_tightest, qa_layout, qa_flattened, original_answers,
        cosine_topk, cosine_pairs, token_overlap_topk, hash_split, hash_split_shares, hash_sample, batched, truncate_pre_post, feature_arrays, piece_labels, stub_labels,
        viterbi_labels, masked_paths, mean_losses, question_training, stream_codes, stream_hourly, stream_once, stream_box_texts,
    )
}

STEP_4 = ((2.0, 0.0, -9.0, 1.0), (0.0, -1.0, 3.0, 0.0), (0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 0.0, 0.0))
STEP_3 = ((2.0, 0.0, -1.0), (0.0, -1.0, 3.0), (0.5, 0.0, 1.0))


def _paths_sql(step, first: int, most: str, name: str) -> str:
    """Best paths, each label's best path so far carried along."""
    n = range(len(step))

    def first_of(parts: list[str], values: list[str]) -> str:
        whens = " ".join(f"WHEN {p} >= greatest({', '.join(parts)}) THEN {v}" for p, v in zip(parts[:-1], values))
        return f"CASE {whens} ELSE {values[-1]} END"

    score = lambda p, j: f"((l[{p} + 1] * 7 + {j * 13} + ({p}) * 3) % 17)::DOUBLE"
    into = [[f"s{i} + {step[i][j]}" for i in n] for j in n]
    begin = ", ".join(f"{score(first, j)} AS s{j}, '{j}' AS p{j}" for j in n)
    then = ", ".join(f"greatest({', '.join(into[j])}) + {score('p + 1', j)}, {first_of(into[j], [f'p{i}' for i in n])} || '{j}'" for j in n)
    best = first_of([f"s{i}" for i in n], [f"p{i}" for i in n])
    return f"""WITH RECURSIVE e AS (SELECT example_id AS d, list_transform(words, lambda x: length(coalesce(x, ''))) AS l, {most} AS n FROM examples WHERE words IS NOT NULL),
v AS (SELECT d, l, n, {first} AS p, {begin} FROM e WHERE n > {first} UNION ALL SELECT d, l, n, p + 1, {then} FROM v WHERE p + 1 < n)
SELECT e.d AS doc_id, coalesce({best}, '') AS {name} FROM e LEFT JOIN (SELECT * FROM v WHERE p = n - 1) v ON v.d = e.d"""


_bucket = "(((({0} + {1}) % 1000003) * 2654435761) % 100)"
_NBEST = "nb AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY qas_id, text ORDER BY score DESC, chunk, s, e) = 1)"

SQL = {
    "chunk_windows": f"WITH {CHUNKS} SELECT item_id, chunk, start, size FROM ch",
    "chunk_windows_examples": """WITH e AS (SELECT example_id, len(words) AS n FROM examples WHERE len(words) > 0),
c AS (SELECT example_id, n, unnest(range(CASE WHEN n <= 300 THEN 1 ELSE 1 + CAST(ceil((n - 300) / 50.0) AS BIGINT) END))::INTEGER AS chunk FROM e)
SELECT example_id, chunk, chunk * 50 AS start, least(300, n - chunk * 50)::INTEGER AS size FROM c""",
    "max_context": f"""WITH {CHUNKS}, p AS (SELECT item_id, chunk, start, size, unnest(range(start, start + size))::INTEGER AS pos FROM ch)
SELECT item_id, pos, chunk FROM p QUALIFY row_number() OVER (PARTITION BY item_id, pos ORDER BY least(pos - start, start + size - 1 - pos) * 100 + size DESC, chunk) = 1""",
    "qa_candidates": f"WITH {CHUNKS}, {LOGITS}, {CANDIDATES} SELECT qas_id, chunk, s, e, score FROM cand",
    "qa_nbest": f"""WITH {CHUNKS}, {LOGITS}, {CANDIDATES}, {_NBEST}
SELECT qas_id, row_number() OVER (PARTITION BY qas_id ORDER BY score DESC, chunk, s, e)::INTEGER AS rank, chunk, s, e, score, text FROM nb QUALIFY rank <= 10""",
    "qa_nbest_json": f"""WITH {CHUNKS}, {LOGITS}, {CANDIDATES}, {_NBEST}, k AS (SELECT qas_id, row_number() OVER (PARTITION BY qas_id ORDER BY score DESC, chunk, s, e) AS rank, s, e, score, text FROM nb QUALIFY rank <= 10),
x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY qas_id)) AS x FROM k), p AS (SELECT *, round(x / sum(x) OVER (PARTITION BY qas_id), 6) AS p FROM x)
SELECT qas_id, list({{'text': text, 'probability': p, 'score': score, 'start_index': s, 'end_index': e}} ORDER BY rank)::JSON::VARCHAR AS nbest FROM p GROUP BY qas_id""",
    "qa_vote": f"""WITH {CHUNKS}, v AS (SELECT item_id AS qas_id, (item_id * 7 % 5 + chunk > 2)::BIGINT AS no_answer FROM ch)
SELECT qas_id, count(*) AS n_chunks, sum(no_answer)::BIGINT AS n_none, sum(no_answer) < count(*) AS answered FROM v GROUP BY qas_id""",
    "qa_softmax": f"""WITH {CHUNKS}, {LOGITS}, m AS (SELECT *, max(sl) OVER (PARTITION BY item_id, chunk) AS mx FROM lg)
SELECT item_id AS qas_id, chunk, round(1 / sum(exp(sl - mx)), 9) AS largest, round(ln(sum(exp(sl - mx))) + max(mx), 9) AS lse FROM m GROUP BY item_id, chunk""",
    "qa_widened": f"""WITH {CHUNKS}, {LOGITS}, {CANDIDATES}, {_NBEST}, b AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY qas_id ORDER BY score DESC, chunk, s, e) = 1)
SELECT qas_id, greatest(s - 10, 0)::INTEGER AS wide_start, least(e + 10, size - 1)::INTEGER AS wide_end FROM b JOIN ch ON ch.item_id = b.qas_id AND ch.chunk = b.chunk""",
    "qa_tightest": """SELECT item_id, CASE WHEN instr(context, answer) > 0 THEN instr(context, answer) - 1 ELSE 0 END::INTEGER AS start,
  (CASE WHEN instr(context, answer) > 0 THEN instr(context, answer) + length(answer) - 2 ELSE length(context) - 1 END)::INTEGER AS "end" FROM eval_items WHERE answer <> '' AND context <> ''""",
    "qa_layout": f"""WITH {CHUNKS}, q AS (SELECT item_id, least(length(question), 64) AS lq FROM eval_items)
SELECT item_id, chunk, (lq + size + 3)::INTEGER AS used, (size + 1)::INTEGER AS segment_ids, (size + 1)::INTEGER AS span_mask, (lq + size + 3)::INTEGER AS input_mask FROM ch JOIN q USING (item_id)""",
    "qa_flattened": """SELECT item_id::VARCHAR AS doc_id, item_id::VARCHAR AS qas_id, question, answer, CASE WHEN answer = '' THEN 0 WHEN instr(context, answer) > 0 THEN (instr(context, answer) - 1)::INTEGER END AS answer_start FROM eval_items""",
    "cosine_topk": """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id)::INTEGER AS rank FROM p QUALIFY rank <= 10""",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "token_overlap_topk": """WITH q AS (SELECT DISTINCT mention_id AS query_id, unnest(string_split(value, '')) AS t FROM mentions WHERE category IN ('ad_diag', 'dis_diag')),
d AS (SELECT DISTINCT item_id AS entry_pos, unnest(string_split(answer, '')) AS t FROM eval_items WHERE question IS NOT NULL),
p AS (SELECT query_id, entry_pos, count(*) AS overlap FROM q JOIN d USING (t) WHERE t <> '' GROUP BY ALL)
SELECT query_id, entry_pos, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, entry_pos DESC)::INTEGER AS rank FROM p QUALIFY rank <= 10""",
    "hash_split": f"""WITH b AS (SELECT example_id, {_bucket.format('example_id', 0)} AS b FROM examples)
SELECT CASE WHEN b >= 30 THEN 'train' WHEN b < 9 THEN 'dev' ELSE 'test' END AS split, count(*) AS n, sum(example_id)::BIGINT AS ids FROM b GROUP BY ALL""",
    "hash_split_shares": f"""WITH b AS (SELECT example_id, {_bucket.format('example_id', 0)} AS b FROM examples)
SELECT example_id, CASE WHEN b < 10 THEN 'test' WHEN b < 20 THEN 'dev' ELSE 'train' END AS split FROM b""",
    "hash_sample": f"SELECT doc_id, source FROM documents WHERE {_bucket.format('doc_id', 42)} < 10",
    "batched": "SELECT mention_id, category, ((row_number() OVER (PARTITION BY category ORDER BY mention_id) - 1) // 32)::INTEGER AS batch FROM mentions",
    "truncate_pre_post": """WITH w AS (SELECT example_id, list_transform(words, lambda x: coalesce(x, '')) AS w FROM examples WHERE words IS NOT NULL), t AS (SELECT example_id, w[1:126] AS a, w[greatest(len(w) - 125, 1):] AS b FROM w)
SELECT example_id, (len(a) + 2)::INTEGER AS n_pre, md5('[CLS]|' || CASE WHEN len(a) > 0 THEN array_to_string(a, '|') || '|' ELSE '' END || '[SEP]') AS pre, len(b)::INTEGER AS n_post, md5(coalesce(array_to_string(b, '|'), '')) AS post FROM t""",
    "feature_arrays": """WITH e AS (SELECT example_id, words[1:126] AS w, labels[1:126] AS l FROM examples WHERE words IS NOT NULL AND labels IS NOT NULL)
SELECT example_id, 128 AS size, (len(w) + 2)::INTEGER AS input_len, (203 + coalesce(list_sum(list_transform(w, lambda x: length(coalesce(x, '')) + 1000)), 0))::BIGINT AS input_ids, (len(w) + 2)::BIGINT AS input_mask,
  (coalesce(list_sum(list_transform(l, lambda x: length(coalesce(x, 'O')))), 0) - 100 * (128 - len(l)))::BIGINT AS label_ids FROM e""",
    "piece_labels": """WITH t AS (SELECT example_id, unnest(words) AS w, unnest(labels) AS l FROM examples WHERE words IS NOT NULL AND labels IS NOT NULL), p AS (SELECT example_id, greatest((length(coalesce(w, '')) + 1) // 2, 1) AS k, length(coalesce(w, '')) = 0 AS none, length(coalesce(l, 'O')) AS lab FROM t)
SELECT example_id AS doc_id, sum(k)::BIGINT AS pieces, sum(lab - 100 * (k - 1))::BIGINT AS label_sum, count(*) FILTER (none) AS unused FROM p GROUP BY ALL""",
    "stub_labels": """WITH t AS (SELECT example_id AS doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM examples WHERE words IS NOT NULL),
s AS (SELECT doc_id, p, length(coalesce(w, '')) * 7 + p * 3 AS b FROM t), a AS (SELECT doc_id, p, [b % 17, (b + 13) % 17, (b + 26) % 17, (b + 39) % 17] AS r FROM s)
SELECT example_id AS doc_id, coalesce(string_agg((list_position(r, list_max(r)) - 1)::VARCHAR, '' ORDER BY p), '') AS labels FROM examples LEFT JOIN a ON doc_id = example_id WHERE words IS NOT NULL GROUP BY example_id""",
    "viterbi_labels": _paths_sql(STEP_4, 0, "len(words)", "path"),
    "masked_paths": _paths_sql(STEP_3, 1, "least(len(words), 128)", "path"),
    "mean_losses": """WITH t AS (SELECT unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM examples WHERE words IS NOT NULL), b AS (SELECT length(coalesce(w, '')) * 7 + p * 3 AS b FROM t WHERE p >= 1),
e AS (SELECT (b % 17)::DOUBLE AS x, ((b + 13) % 17)::DOUBLE AS y, ((b + 26) % 17)::DOUBLE AS z FROM b)
SELECT count(*)::BIGINT AS n, round(avg(ln(exp(x) + exp(y) + exp(z)) - CASE WHEN x > y THEN x ELSE y END), 6) AS mean_loss FROM e""",
    "question_training": f"""WITH {CHUNKS}, q AS (SELECT item_id, least(length(question), 64) AS lq, coalesce(answer, '') AS a, instr(context, coalesce(answer, '')) - 1 AS f FROM eval_items WHERE context <> '')
SELECT item_id, chunk, (CASE WHEN a = '' THEN 2 ELSE f - start + lq + 2 END)::INTEGER AS start_position, (CASE WHEN a = '' THEN 5 ELSE f + length(a) - 1 - start + lq + 2 END)::INTEGER AS end_position, (a = '')::INTEGER AS no_answer
FROM ch JOIN q USING (item_id) WHERE a = '' OR (f >= 0 AND f >= start AND f + length(a) - 1 <= start + size - 1)""",
    "stream_once": "SELECT DISTINCT doc_id FROM ocr_raw WHERE received_at IS NOT NULL",
    "stream_box_texts": f"""WITH RECURSIVE {BOXES} SELECT raw_id, box_path, regexp_replace(replace(b ->> '$.text', chr(10), 'mjwemptymjw'), '[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b]', '', 'g') AS text FROM boxes WHERE b ->> '$.text' IS NOT NULL""",
    "stream_codes": f"""WITH RECURSIVE {BOXES}, r AS (SELECT coalesce(x ->> '$.error', '') AS error, coalesce(r ->> '$.message', '') AS message, x ->> '$.error' IS NULL AND r ->> '$.message' IS NULL AS missing, coalesce(len({listed('r', '$.info')}), 0) AS n FROM res)
SELECT CASE WHEN missing THEN '10002' WHEN message <> 'success' OR error <> '' THEN '10006' ELSE '200' END AS code, count(*) AS responses, sum(n)::BIGINT AS elements FROM r GROUP BY 1""",
    "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
