"""Queries over tag sequences, mentions and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import assign, bio, datasets, metrics
from docloom.schemas import task_categories, task_categories_sql
from docloom.session import read
from docloom.sources import readers, sinks

GLUE = "Hospital_Name"

TOK = """
tok AS (SELECT example_id AS doc_id, i::INTEGER AS pos, words[i+1] AS token, labels[i+1] AS label
  FROM (SELECT example_id, words, labels, unnest(range(len(words))) AS i FROM examples WHERE words IS NOT NULL AND labels IS NOT NULL))"""

# a second tagging of the same texts: every eleventh label is lost
PRED = """
ptok AS (SELECT doc_id, pos, token, CASE WHEN pos % 11 = 3 THEN 'O' ELSE label END AS label FROM tok)"""


def _decode_sql(name: str, source: str, glue: str | None = None) -> str:
    begins = "lab LIKE 'B-%'"
    if glue:
        begins = f"lab LIKE 'B-%' AND NOT (lab = 'B-{glue}' AND coalesce(before, '') = 'I-{glue}')"
    return f"""
{name}_1 AS (SELECT *, coalesce(label, 'O') AS lab, lag(label) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM {source}),
{name}_2 AS (SELECT *, sum(CASE WHEN {begins} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS ent FROM {name}_1),
{name}_3 AS (SELECT *, sum(CASE WHEN lab LIKE 'B-%' OR lab LIKE 'I-%' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, ent ORDER BY pos) AS closed FROM {name}_2),
{name} AS (SELECT doc_id, ent::BIGINT AS ent, arg_min(substring(lab, 3), pos) AS category, min(pos) AS start_pos, count(*) AS n_tokens,
  string_agg(coalesce(token, ''), '' ORDER BY pos) AS value FROM {name}_3 WHERE ent > 0 AND closed = 0 GROUP BY doc_id, ent)"""


def _typed_sql(name: str, source: str) -> str:
    return f"""
{name}_1 AS (SELECT *, CASE WHEN label LIKE 'B-%' OR label LIKE 'I-%' THEN substring(label, 3) END AS kind FROM {source}),
{name}_2 AS (SELECT *, CASE WHEN coalesce(label, 'O') LIKE 'B-%' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM {name}_1),
{name}_3 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS isle FROM {name}_2),
{name} AS (SELECT doc_id, min(kind) AS category, min(pos) AS start, (max(pos) + 1)::INTEGER AS "end", string_agg(coalesce(token, ''), '' ORDER BY pos) AS value
  FROM {name}_3 WHERE kind IS NOT NULL GROUP BY doc_id, isle HAVING arg_min(label, pos) LIKE 'B-%')"""


COUNTS = """
counts AS (SELECT category, coalesce(sum(p), 0)::BIGINT AS pred, coalesce(sum(g), 0)::BIGINT AS gold, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS correct
  FROM (SELECT DISTINCT doc_id, category, value, 1 AS p FROM pm WHERE value <> '') a
  FULL JOIN (SELECT DISTINCT doc_id, category, value, 1 AS g FROM gm WHERE value <> '') b USING (doc_id, category, value) GROUP BY category)"""

SMOOTH = """correct::DOUBLE / (pred + 1) AS precision, (correct + 1)::DOUBLE / (gold + 1) AS recall,
  2 * (correct::DOUBLE / (pred + 1)) * ((correct + 1)::DOUBLE / (gold + 1)) / (correct::DOUBLE / (pred + 1) + (correct + 1)::DOUBLE / (gold + 1)) AS f1"""

CAPITALS = "length(regexp_replace(value, '[^A-Z]', '', 'g'))"
MENTION_VALUES = "SELECT doc_id, category, value, pos, mention_id FROM mentions WHERE doc_id IS NOT NULL AND value IS NOT NULL"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.to_tokens(read(spark, sf_dir, "examples"), "example_id")


def pred_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).withColumn("label", F.when(F.col("pos") % 11 == 3, "O").otherwise(F.col("label")))


def bio_decode(spark, sf_dir):
    return bio.decode(tokens(spark, sf_dir), glue=GLUE)


def bio_typed_offsets(spark, sf_dir):
    return bio.decode_typed(tokens(spark, sf_dir))


def bio_id_merge(spark, sf_dir):
    tag = F.when(F.col("label").startswith("B-"), 2).when(F.col("label").startswith("I-"), 3).otherwise(0)
    return bio.decode_ids(tokens(spark, sf_dir).withColumn("tag", tag))


def _both(spark, sf_dir):
    return bio.decode(pred_tokens(spark, sf_dir), glue=GLUE), bio.decode(tokens(spark, sf_dir), glue=GLUE)


def prf_by_category(spark, sf_dir):
    return metrics.report(metrics.with_overall(metrics.counts(*_both(spark, sf_dir))))


def prf_duplicates(spark, sf_dir):
    """Duplicates of a document count on either side."""
    return metrics.counts(*_both(spark, sf_dir), to_set=False)


def prf_strict(spark, sf_dir):
    """Unsmoothed scores; a repeated prediction of a gold value is correct again."""
    c = metrics.counts(*_both(spark, sf_dir), to_set=False, each=True)
    return c.select("category", *metrics.strict(F.col("pred"), F.col("gold"), F.col("correct")))


def prf_gated(spark, sf_dir):
    """Counted only where a second gold labelling (some labels lost) agrees with the first."""
    pred, gold = _both(spark, sf_dir)
    second = tokens(spark, sf_dir).withColumn("label", F.when(F.col("pos") % 17 == 5, "O").otherwise(F.col("label")))
    return metrics.counts(pred, gold, gate=bio.decode(second, glue=GLUE))


def token_accuracy(spark, sf_dir):
    t = tokens(spark, sf_dir).select("doc_id", "pos", F.coalesce("label", F.lit("O")).alias("gold"))
    p = pred_tokens(spark, sf_dir).select("doc_id", "pos", F.coalesce("label", F.lit("O")).alias("pred"))
    return bio.token_accuracy(t.join(p, ["doc_id", "pos"]), pad="B-Name")


def entity_exact(spark, sf_dir):
    return bio.entity_scores(bio.decode_typed(tokens(spark, sf_dir)), bio.decode_typed(pred_tokens(spark, sf_dir)))


def entity_averages(spark, sf_dir):
    """Exact matches of spans with micro and macro averages."""
    t = metrics.averages(entity_exact(spark, sf_dir))
    return t.select("category", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def label_diff(spark, sf_dir):
    """Documents and categories whose value sets differ between the two taggings."""
    pred, gold = (metrics.value_sets(m) for m in _both(spark, sf_dir))
    j = gold.withColumnRenamed("values", "g").join(pred.withColumnRenamed("values", "p"), ["doc_id", "category"], "full_outer")
    empty = F.array().cast("array<string>")
    g, p = F.coalesce("g", empty), F.coalesce("p", empty)
    lost, extra = F.size(F.array_except(g, p)), F.size(F.array_except(p, g))
    kind = F.when(F.size(p) == 0, "missing").when(F.size(g) == 0, "extra").otherwise("changed")
    return j.where((lost > 0) | (extra > 0)).select("doc_id", "category", lost.alias("lost"), extra.alias("extra"), kind.alias("kind"))


def error_class(spark, sf_dir):
    """Wrong values told apart: the text does not hold the value, or it was not extracted."""
    pred, gold = _both(spark, sf_dir)
    first = gold.groupBy("doc_id", "category").agg(F.min_by("value", "ent").alias("gold_value"))
    got = pred.groupBy("doc_id", "category").agg(F.min_by("value", "ent").alias("pred_value"))
    read_as = F.when(F.col("pos") % 13 == 5, "□").otherwise(F.coalesce("token", F.lit("")))
    text = tokens(spark, sf_dir).groupBy("doc_id").agg(assign.in_order(read_as, F.col("pos")).alias("t"))
    j = first.join(got, ["doc_id", "category"], "left").join(text.select("doc_id", F.array_join("t", "").alias("text")), "doc_id")
    wrong = j.where(~F.col("gold_value").eqNullSafe(F.col("pred_value")))
    kind = F.when(~F.contains("text", F.col("gold_value")), "recognition").otherwise("extraction")
    return wrong.groupBy("category", kind.alias("kind")).agg(F.count("*").alias("n"))


def mentions_by_category(spark, sf_dir):
    m = read(spark, sf_dir, "mentions").where("doc_id is not null")
    full = assign.by_category(m, task_categories(spark))
    return full.select("doc_id", "task", "category", F.size("values").alias("n"), F.array_join("values", "|").alias("joined"))


def unknown_categories(spark, sf_dir):
    few = task_categories(spark).where("category <> 'Name'")
    return assign.unknown_categories(read(spark, sf_dir, "mentions"), few).select("mention_id", "task", "category")


def first_seen(spark, sf_dir):
    return assign.first_seen(read(spark, sf_dir, "mentions").where("doc_id is not null"))


def containment_dedup(spark, sf_dir):
    m = read(spark, sf_dir, "mentions").where("doc_id is not null and value is not null")
    g = m.groupBy("doc_id", "category").agg(assign.in_order(F.col("value"), F.col("pos"), F.col("mention_id")).alias("values"))
    return g.select("doc_id", "category", F.array_join(assign.contained_out(F.col("values")), "|").alias("kept"))


def case_variant_dedup(spark, sf_dir):
    return assign.case_variants_out(read(spark, sf_dir, "mentions").where("doc_id is not null and value is not null and category like '%_PY'"))


def train_values_out(spark, sf_dir):
    """Values the model read, without those that rules had read as well."""
    m = read(spark, sf_dir, "mentions").where("value is not null").select("mention_id", "value", "pred_type")
    return assign.train_values_out(m.where("pred_type = 'model'"), m.where("pred_type = 'rule'")).select("mention_id", "value")


def cleaned_values(spark, sf_dir):
    """The values of each document as they are kept; those of the interface count as seen."""
    m = read(spark, sf_dir, "mentions").where("value is not null and doc_id is not null")
    return assign.cleaned_values(m.where("category in ('ad_diag', 'dis_diag', 'Department', 'Conclusion', 'Name_PY')"), m.where("pred_type = 'interface'"))


def answers_wide(spark, sf_dir):
    m = read(spark, sf_dir, "mentions").where("doc_id is not null and task = 'imaging_report'")
    full = assign.by_category(m, task_categories(spark))
    return assign.wide(full, ["Name", "Hospital_Name", "Check_Part"])


def response_json(spark, sf_dir):
    m = read(spark, sf_dir, "mentions").where("doc_id is not null and task = 'xingchengdan' and category in ('Flight_Number', 'Ticket_Fee', 'Total_Fee')")
    cats = task_categories(spark).where("category in ('Flight_Number', 'Ticket_Fee', 'Total_Fee')")
    return assign.responses(assign.answers(assign.by_category(m, cats)))


def packed_mentions(spark, sf_dir):
    m = read(spark, sf_dir, "mentions").where("doc_id is not null and value is not null").select("doc_id", "category", "value")
    return assign.unpacked(assign.packed(m)).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


def value_positions(spark, sf_dir):
    text = tokens(spark, sf_dir).groupBy("doc_id").agg(assign.in_order(F.coalesce("token", F.lit("")), F.col("pos")).alias("t"))
    found = assign.positions(bio.decode(tokens(spark, sf_dir), glue=GLUE).select("doc_id", "ent", "value"), text.select("doc_id", F.array_join("t", "").alias("text")))
    return found.select("doc_id", "ent", "text_pos")


def tagged_round_trip(spark, sf_dir):
    """Tokens written as ``token label`` lines and read again."""
    solid = tokens(spark, sf_dir).where("token is not null and length(trim(token)) > 0 and not contains(token, ' ')")
    text = sinks.tagged_text(solid)
    back = readers.tagged_lines(text, "doc_id")
    return back.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("chars"), F.count(F.when(F.col("label") != "O", 1)).alias("tagged"))


def predicted_lines(spark, sf_dir):
    """Predictions put back on the token lines; those cut off are left out."""
    e = read(spark, sf_dir, "examples").where("words is not null and labels is not null").withColumnRenamed("example_id", "doc_id")
    second = F.transform("words", lambda _, i: F.when(i % 11 == 3, "O").otherwise(F.get("labels", i)))
    lines = sinks.predicted(e.select("doc_id", "words"), e.select("doc_id", F.slice(second, 1, 126).alias("labels")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(F.col("label").startswith("B-"), 1)).alias("begins"))


def label_dimension(spark, sf_dir):
    """Label lists per task as text and back, the outside label first."""
    lab = read(spark, sf_dir, "label_list").groupBy("task").agg(F.array_join(assign.in_order(F.col("label"), F.col("label_id")), "\n").alias("text"))
    return lab.select("task", F.posexplode(readers.labels_of(F.col("text"))).alias("label_id", "label"))


def label_types(spark, sf_dir):
    lab = tx.label_type(F.col("label"))
    return tokens(spark, sf_dir).groupBy(lab.alias("kind")).agg(F.count("*").alias("tokens"), F.avg(F.length("token")).alias("mean_length"))


def fuzzy_headers(spark, sf_dir):
    """Values that share two characters with a header word."""
    m = read(spark, sf_dir, "mentions").where("value is not null and category in ('Check_Part', 'Conclusion', 'dis_diag')")
    n = tx.shared_characters(F.col("value"), F.lit("左侧骨折"))
    return m.where(n >= 2).select("mention_id", n.alias("shared"))


def mentions_of_responses(spark, sf_dir):
    m = read(spark, sf_dir, "mentions").where("doc_id is not null and task = 'boardcards'")
    back = assign.mentions_of_responses(assign.answers(assign.by_category(m, task_categories(spark))))
    return back.groupBy("category", "value").agg(F.count("*").alias("n"))


def shuffled_order(spark, sf_dir):
    return datasets.shuffled(read(spark, sf_dir, "examples").select("example_id"), "example_id", seed=42)


def latency_stats(spark, sf_dir):
    s = metrics.latency(read(spark, sf_dir, "events"), "event_type", "value")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), "least", "most", "median")


QUERIES = {
    f.__name__: f
    for f in (
        bio_decode, bio_typed_offsets, bio_id_merge, prf_by_category, prf_duplicates, prf_strict, prf_gated, token_accuracy, entity_exact, entity_averages, label_diff, error_class,
        mentions_by_category, unknown_categories, first_seen, containment_dedup, case_variant_dedup, train_values_out, cleaned_values, answers_wide, response_json, packed_mentions,
        value_positions, tagged_round_trip, predicted_lines, label_dimension, label_types, fuzzy_headers, mentions_of_responses, shuffled_order, latency_stats,
    )
}

_ODD = r"[\x{200b}“”\x{00a0}\x{3000}]"
_pair = f"WITH {TOK}, {PRED}, {_decode_sql('gm', 'tok', GLUE)}, {_decode_sql('pm', 'ptok', GLUE)}"
_assigned = f"""
cats(task, cat_pos, category) AS (VALUES {task_categories_sql()}),
m1 AS (SELECT doc_id, task, category, pos, mention_id, CASE WHEN category IN ('age', 'sex', 'bed_number')
    THEN replace(replace(replace(replace(upper(value), '病区', ''), '病房', ''), '岁', ''), '床', '') ELSE upper(value) END AS value
  FROM mentions WHERE doc_id IS NOT NULL),
grp AS (SELECT doc_id, task, category, count(*) AS n, string_agg(value, '|' ORDER BY pos, mention_id) AS joined,
    string_agg(value, ' ' ORDER BY pos, mention_id) AS blanks, string_agg(value, '@#' ORDER BY pos, mention_id) AS wide FROM m1 WHERE value <> '' GROUP BY ALL),
full_ AS (SELECT d.doc_id, d.task, c.category, coalesce(g.n, 0)::INTEGER AS n, coalesce(g.joined, '') AS joined, coalesce(g.blanks, '') AS blanks, coalesce(g.wide, '') AS wide
  FROM (SELECT DISTINCT doc_id, task FROM mentions WHERE doc_id IS NOT NULL) d JOIN cats c USING (task) LEFT JOIN grp g USING (doc_id, task, category))"""
_esc = """replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), '^', ' ')"""

SQL = {
    "bio_decode": f"WITH {TOK}, {_decode_sql('m', 'tok', GLUE)} SELECT * FROM m",
    "bio_typed_offsets": f"WITH {TOK}, {_typed_sql('m', 'tok')} SELECT * FROM m",
    "bio_id_merge": f"""WITH {TOK},
t0 AS (SELECT *, CASE WHEN label LIKE 'B-%' THEN 2 WHEN label LIKE 'I-%' THEN 3 ELSE 0 END AS tag FROM tok),
t1 AS (SELECT *, CASE WHEN tag = 2 AND coalesce(lag(CASE WHEN tag IN (2, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS new FROM t0),
t2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM t1),
t3 AS (SELECT *, sum(CASE WHEN tag IN (2, 3) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, island ORDER BY pos) AS closed FROM t2),
g AS (SELECT doc_id, island::BIGINT AS island, min(pos) AS start_pos, string_agg(coalesce(token, ''), '' ORDER BY pos) AS value FROM t3 WHERE island > 0 AND closed = 0 GROUP BY doc_id, island)
SELECT * FROM g QUALIFY island < max(island) OVER (PARTITION BY doc_id)""",
    "prf_by_category": f"""{_pair}, {COUNTS}, allc AS (SELECT * FROM counts UNION ALL SELECT 'overall', sum(pred)::BIGINT, sum(gold)::BIGINT, sum(correct)::BIGINT FROM counts)
SELECT category, pred, gold, correct, {SMOOTH} FROM allc""",
    "prf_duplicates": f"""{_pair}
SELECT category, coalesce(sum(p), 0)::BIGINT AS pred, coalesce(sum(g), 0)::BIGINT AS gold, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS correct
FROM (SELECT doc_id, category, value, count(*) AS p FROM pm WHERE value <> '' GROUP BY ALL) a
FULL JOIN (SELECT doc_id, category, value, count(*) AS g FROM gm WHERE value <> '' GROUP BY ALL) b USING (doc_id, category, value) GROUP BY category""",
    "prf_strict": f"""{_pair}, c AS (SELECT category, coalesce(sum(p), 0)::BIGINT AS pred, coalesce(sum(g), 0)::BIGINT AS gold, coalesce(sum(p) FILTER (g IS NOT NULL), 0)::BIGINT AS correct
FROM (SELECT doc_id, category, value, count(*) AS p FROM pm WHERE value <> '' GROUP BY ALL) a
FULL JOIN (SELECT doc_id, category, value, count(*) AS g FROM gm WHERE value <> '' GROUP BY ALL) b USING (doc_id, category, value) GROUP BY category)
SELECT category, CASE WHEN pred > 0 THEN correct::DOUBLE / pred END AS precision, CASE WHEN gold > 0 THEN correct::DOUBLE / gold END AS recall,
  CASE WHEN correct > 0 THEN 2 * (correct::DOUBLE / pred) * (correct::DOUBLE / gold) / (correct::DOUBLE / pred + correct::DOUBLE / gold) END AS f1 FROM c""",
    "prf_gated": f"""{_pair}, stok AS (SELECT doc_id, pos, token, CASE WHEN pos % 17 = 5 THEN 'O' ELSE label END AS label FROM tok), {_decode_sql('sm', 'stok', GLUE)},
g AS (SELECT DISTINCT doc_id, category, value, 1 AS g FROM gm WHERE value <> ''), h AS (SELECT DISTINCT doc_id, category, value, 1 AS h FROM sm WHERE value <> ''), p AS (SELECT DISTINCT doc_id, category, value, 1 AS p FROM pm WHERE value <> ''),
same AS (SELECT doc_id, category FROM g FULL JOIN h USING (doc_id, category, value) GROUP BY doc_id, category HAVING bool_and(g IS NOT NULL AND h IS NOT NULL))
SELECT category, coalesce(sum(p), 0)::BIGINT AS pred, coalesce(sum(g), 0)::BIGINT AS gold, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS correct
FROM p FULL JOIN g USING (doc_id, category, value) WHERE (doc_id, category) IN (SELECT (doc_id, category) FROM same) GROUP BY category""",
    "token_accuracy": f"""WITH {TOK}, {PRED}
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (coalesce(a.label, 'O') = coalesce(b.label, 'O')) AS n_equal,
  count(*) FILTER (coalesce(a.label, 'O') = coalesce(b.label, 'O'))::DOUBLE / count(*) AS accuracy
FROM tok a JOIN ptok b USING (doc_id, pos) WHERE coalesce(a.label, 'O') <> 'B-Name' GROUP BY doc_id""",
    "entity_exact": f"""WITH {TOK}, {PRED}, {_typed_sql('gm', 'tok')}, {_typed_sql('pm', 'ptok')}
SELECT category, count(g) AS gold, count(p) AS pred, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS correct
FROM (SELECT doc_id, category, start, "end", 1 AS g FROM gm) a FULL JOIN (SELECT doc_id, category, start, "end", 1 AS p FROM pm) b USING (doc_id, category, start, "end") GROUP BY category""",
    "entity_averages": f"""WITH {TOK}, {PRED}, {_typed_sql('gm', 'tok')}, {_typed_sql('pm', 'ptok')},
c AS (SELECT category, count(g) AS gold, count(p) AS pred, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS correct
FROM (SELECT doc_id, category, start, "end", 1 AS g FROM gm) a FULL JOIN (SELECT doc_id, category, start, "end", 1 AS p FROM pm) b USING (doc_id, category, start, "end") GROUP BY category),
s AS (SELECT category, gold, pred, correct FROM c UNION ALL SELECT 'micro avg', sum(gold), sum(pred), sum(correct) FROM c),
e AS (SELECT category, CASE WHEN pred > 0 THEN correct::DOUBLE / pred ELSE 0 END AS p, CASE WHEN gold > 0 THEN correct::DOUBLE / gold ELSE 0 END AS r, gold::BIGINT AS support FROM s),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM e)
SELECT category, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support FROM f UNION ALL
SELECT 'macro avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9), round(sum(f * support) / sum(support), 9), sum(support)::BIGINT FROM f WHERE category <> 'micro avg'""",
    "label_diff": f"""{_pair}, j AS (SELECT doc_id, category, value, g, p FROM (SELECT DISTINCT doc_id, category, value, 1 AS g FROM gm WHERE value <> '') a
  FULL JOIN (SELECT DISTINCT doc_id, category, value, 1 AS p FROM pm WHERE value <> '') b USING (doc_id, category, value))
SELECT doc_id, category, (count(*) FILTER (p IS NULL))::INTEGER AS lost, (count(*) FILTER (g IS NULL))::INTEGER AS extra,
  CASE WHEN count(p) = 0 THEN 'missing' WHEN count(g) = 0 THEN 'extra' ELSE 'changed' END AS kind
FROM j GROUP BY doc_id, category HAVING count(*) FILTER (p IS NULL) > 0 OR count(*) FILTER (g IS NULL) > 0""",
    "error_class": f"""{_pair}, first_ AS (SELECT doc_id, category, arg_min(value, ent) AS gold_value FROM gm GROUP BY ALL),
got AS (SELECT doc_id, category, arg_min(value, ent) AS pred_value FROM pm GROUP BY ALL),
txt AS (SELECT doc_id, string_agg(CASE WHEN pos % 13 = 5 THEN '□' ELSE coalesce(token, '') END, '' ORDER BY pos) AS text FROM tok GROUP BY doc_id)
SELECT category, CASE WHEN NOT contains(text, gold_value) THEN 'recognition' ELSE 'extraction' END AS kind, count(*) AS n
FROM first_ LEFT JOIN got USING (doc_id, category) JOIN txt USING (doc_id) WHERE gold_value IS DISTINCT FROM pred_value GROUP BY ALL""",
    "mentions_by_category": f"WITH {_assigned} SELECT doc_id, task, category, n, joined FROM full_",
    "unknown_categories": f"""WITH cats(task, cat_pos, category) AS (VALUES {task_categories_sql()})
SELECT mention_id, task, category FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM cats c WHERE c.task = m.task AND c.category = m.category AND c.category <> 'Name')""",
    "first_seen": "SELECT doc_id, category, value, min(pos) AS first_pos FROM mentions WHERE doc_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL",
    "containment_dedup": f"""WITH m AS ({MENTION_VALUES}), n AS (SELECT doc_id, category, count(*) AS n FROM m GROUP BY ALL),
kept AS (SELECT a.* FROM m a JOIN n USING (doc_id, category) WHERE n = 1 OR NOT EXISTS (SELECT 1 FROM m b
  WHERE b.doc_id = a.doc_id AND b.category = a.category AND b.mention_id <> a.mention_id AND contains(b.value, a.value)))
SELECT doc_id, category, coalesce(string_agg(k.value, '|' ORDER BY k.pos, k.mention_id), '') AS kept FROM n LEFT JOIN kept k USING (doc_id, category) GROUP BY doc_id, category""",
    "case_variant_dedup": f"""WITH v AS (SELECT DISTINCT doc_id, value FROM mentions WHERE doc_id IS NOT NULL AND value IS NOT NULL AND category LIKE '%_PY')
SELECT doc_id, value FROM v QUALIFY {CAPITALS} = max({CAPITALS}) OVER (PARTITION BY doc_id, lower(value))""",
    "train_values_out": f"""SELECT value, mention_id FROM mentions WHERE pred_type = 'model' AND length(value) > 1 AND NOT regexp_matches(value, '{_ODD}')
AND value NOT IN (SELECT value FROM mentions WHERE pred_type = 'rule' AND value IS NOT NULL)""",
    "cleaned_values": f"""WITH v AS (SELECT DISTINCT doc_id, translate(value, '。【】', '') AS value FROM mentions WHERE doc_id IS NOT NULL AND category IN ('ad_diag', 'dis_diag', 'Department', 'Conclusion', 'Name_PY')),
c AS (SELECT doc_id, value, lower(value) AS l FROM v WHERE value <> '' QUALIFY length(regexp_replace(value, '[^A-Z]', '', 'g')) = max(length(regexp_replace(value, '[^A-Z]', '', 'g'))) OVER (PARTITION BY doc_id, lower(value)))
SELECT doc_id, value FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND contains(o.l, c.l) AND o.value <> c.value) AND length(value) > 1 AND NOT regexp_matches(value, '{_ODD}')
AND value NOT IN (SELECT value FROM mentions WHERE pred_type = 'interface' AND doc_id IS NOT NULL AND value IS NOT NULL)""",
    "answers_wide": f"""WITH {_assigned} SELECT doc_id, max(wide) FILTER (category = 'Name') AS "Name", max(wide) FILTER (category = 'Hospital_Name') AS "Hospital_Name",
  max(wide) FILTER (category = 'Check_Part') AS "Check_Part" FROM full_ WHERE task = 'imaging_report' GROUP BY doc_id""",
    "response_json": f"""WITH {_assigned.replace("FROM mentions WHERE doc_id IS NOT NULL", "FROM mentions WHERE doc_id IS NOT NULL AND task = 'xingchengdan' AND category IN ('Flight_Number', 'Ticket_Fee', 'Total_Fee')")}
SELECT doc_id, task, '{{"code":"200","message":"success","result":{{' || string_agg('"' || category || '":"' || {_esc.format('blanks')} || '"', ',' ORDER BY category) || '}}}}' AS response
FROM full_ WHERE category IN ('Flight_Number', 'Ticket_Fee', 'Total_Fee') GROUP BY doc_id, task""",
    "packed_mentions": "SELECT category, count(*) AS n, count(DISTINCT value) AS values FROM mentions WHERE doc_id IS NOT NULL AND value IS NOT NULL GROUP BY category",
    "value_positions": f"""WITH {TOK}, {_decode_sql('m', 'tok', GLUE)}, txt AS (SELECT doc_id, string_agg(coalesce(token, ''), '' ORDER BY pos) AS text FROM tok GROUP BY doc_id)
SELECT doc_id, ent, CASE WHEN instr(text, value) > 0 THEN (instr(text, value) - 1)::INTEGER END AS text_pos FROM m JOIN txt USING (doc_id)""",
    "tagged_round_trip": f"""WITH {TOK} SELECT doc_id, count(*) AS n, sum(length(token))::BIGINT AS chars, count(*) FILTER (coalesce(label, 'O') <> 'O') AS tagged
FROM tok WHERE length(trim(token)) > 0 AND NOT contains(token, ' ') GROUP BY doc_id""",
    "predicted_lines": f"""WITH {TOK}, {PRED} SELECT doc_id, count(*) AS lines, count(*) FILTER (label LIKE 'B-%') AS begins FROM ptok WHERE pos < 126 GROUP BY doc_id""",
    "label_dimension": """WITH l AS (SELECT task, label, row_number() OVER (PARTITION BY task ORDER BY label_id) - 1 AS i, max(CASE WHEN label = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY task) AS has FROM label_list)
SELECT task, (i + 1 - has)::INTEGER AS label_id, label FROM l UNION ALL SELECT DISTINCT task, 0, 'O' FROM l WHERE has = 0""",
    "label_types": f"WITH {TOK} SELECT regexp_replace(label, '^[BIOSE]-', '') AS kind, count(*) AS tokens, avg(length(token)) AS mean_length FROM tok GROUP BY ALL",
    "fuzzy_headers": """SELECT mention_id, len(list_intersect(list_distinct(string_split(value, '')), ['左', '侧', '骨', '折']))::INTEGER AS shared FROM mentions
WHERE category IN ('Check_Part', 'Conclusion', 'dis_diag') AND len(list_intersect(list_distinct(string_split(value, '')), ['左', '侧', '骨', '折'])) >= 2""",
    "mentions_of_responses": """SELECT category, v AS value, count(*) AS n FROM (SELECT category, unnest(string_split(upper(value), ' ')) AS v FROM mentions WHERE doc_id IS NOT NULL AND task = 'boardcards') WHERE v <> '' GROUP BY ALL""",
    "shuffled_order": "SELECT example_id, (((example_id + 42) % 1000003 * 2654435761) % 1000003)::INTEGER AS place FROM examples",
    "latency_stats": """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, quantile_cont(value, 0.5) AS median
FROM events WHERE value IS NOT NULL GROUP BY event_type""",
}
