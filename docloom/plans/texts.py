"""Queries over texts, values, layouts and envelopes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import normalize as nz
from docloom.functions import text as tx
from docloom.operators import envelope, layout, match, nested, values
from docloom.plans.payloads import BOXES as PAYLOAD, CORNERS, TEXTS
from docloom.schemas import LINE_BREAK, TASK_CATEGORIES
from docloom.session import read
from docloom.sources import readers

SPACE_CLASS = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]"
FLIGHT_PATTERNS = ["航班([A-Z]{2}[0-9]{3,4})", "QY[0-9]{3,4}", "[A-Z]{2}[0-9]{4}", "[0-9]{2}(?:JAN|FEB|MAR)[0-9]{0,2}"]
FIELDS = {
    "Admission_Number": ("(?:住院号|病案号)[:：]?[0-9A-Za-z-]+", "住院号|病案号|[:：]"),
    "Money": ("核定[0-9.]+元", "核定|元"),
    "Days": ("误工[0-9]+日", "误工|日"),
}


# ---- the boxes of all recognised pages ---------------------------------------
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of any depth that have all four corners; a document is one page."""
    b = nested.box_corners(read(spark, sf_dir, "ocr_raw")).dropna(subset=[n + k for n in "abcd" for k in "xy"])
    return b.withColumns({"doc_id": F.concat_ws(".", "raw_id", "page"), "box_idx": F.col("box_no")}).drop("raw_id", "page", "box_no")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: the recognised text of each document, of its first delivery."""
    raw = read(spark, sf_dir, "ocr_raw").withColumn("key", F.struct("doc_id", "raw_id"))
    texts = nested.payload_texts(raw, "key").select("key.doc_id", "key.raw_id", "text")
    return texts.groupBy("doc_id").agg(F.min_by("text", "raw_id").alias("text"))


def _with_texts(spark, sf_dir, *cats):
    """Values of some categories with the text of their document, empty where there is none."""
    m = _values(spark, sf_dir, *cats).select("mention_id", "doc_id", "task", "category", "value", "pred_type")
    return m.join(document_texts(spark, sf_dir), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


ROWS = """
r1 AS (SELECT *, lag(avg_y) OVER (PARTITION BY doc_id ORDER BY box_idx) AS prev FROM geo),
rws AS (SELECT *, sum(CASE WHEN min_y >= prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY box_idx)::BIGINT AS row_id FROM r1)"""
ORDERED = """
ord AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, row_id ORDER BY x_center, box_idx) - 1)::INTEGER AS row_pos FROM rws),
gap AS (SELECT *, lead(x_start) OVER (PARTITION BY doc_id, row_id ORDER BY row_pos) AS nxt, avg(height) OVER (PARTITION BY doc_id, row_id) AS font FROM ord),
spc AS (SELECT *, (2 * coalesce(greatest(trunc((nxt - x_end) / font + 2), 0), 0))::INTEGER AS n_blanks FROM gap),
txt AS (SELECT doc_id, row_id, string_agg(coalesce(text, '') || repeat(' ', n_blanks), '' ORDER BY row_pos) AS text, max(x_end) AS x_end, avg(height) AS font FROM spc GROUP BY doc_id, row_id)"""


def _geo(spark, sf_dir):
    return layout.geometry(page_boxes(spark, sf_dir))


def box_geometry(spark, sf_dir):
    return _geo(spark, sf_dir).select("doc_id", "box_idx", "min_y", "avg_y", "x_start", "x_end", "x_center", "height")


def row_group(spark, sf_dir):
    return layout.rows_by_previous(_geo(spark, sf_dir)).select("doc_id", "box_idx", "row_id")


def row_group_font(spark, sf_dir):
    return layout.rows_by_font(_geo(spark, sf_dir)).select("doc_id", "box_idx", "row_id")


def row_order(spark, sf_dir):
    return layout.ordered(layout.rows_by_previous(_geo(spark, sf_dir))).select("doc_id", "box_idx", "row_id", "row_pos")


def row_spacing(spark, sf_dir):
    return layout.gaps(layout.ordered(layout.rows_by_previous(_geo(spark, sf_dir)))).select("doc_id", "box_idx", "n_blanks")


def _rows(spark, sf_dir):
    return layout.row_texts(layout.gaps(layout.ordered(layout.rows_by_previous(_geo(spark, sf_dir)))))


def layout_text(spark, sf_dir):
    return layout.to_text(page_boxes(spark, sf_dir))


def layout_paragraphs(spark, sf_dir):
    rows = layout.paragraph_ends(_rows(spark, sf_dir))
    return layout.document_text(rows, ends=F.col("ends"))


def layout_by_edge(spark, sf_dir):
    return layout.paragraphs_by_edge(_rows(spark, sf_dir)).select("doc_id", "row_id", "para", "para_pos")


def font_size(spark, sf_dir):
    return layout.font_size(_geo(spark, sf_dir), "doc_id").withColumn("font_size", F.round("font_size", 6))


def header_columns(spark, sf_dir):
    """The other boxes of a page under the first three as headers."""
    geo = _geo(spark, sf_dir).withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy("box_idx")))
    at = [F.max(F.when(F.col("__r") == i + 1, F.col("ax"))).alias(n) for i, n in enumerate(("left_x", "mid_x", "right_x"))]
    return layout.columns_by_header(geo.where("__r > 3"), geo.groupBy("doc_id").agg(*at))


def rank_columns(spark, sf_dir):
    return layout.columns_by_rank(_geo(spark, sf_dir), ("first", "second", "third", "fourth", "fifth"))


#: Words on the given papers that stand for the headers of an itinerary.
HEADS = (("检查部位", 2), ("出院日期", 2), ("合计", 2))


def fees(spark, sf_dir):
    """Amounts on recognised pages by the place of three header words."""
    return layout.fees(page_boxes(spark, sf_dir), headers=HEADS)


def ocr_codes(spark, sf_dir):
    return envelope.error_report(envelope.coded(nested.responses(read(spark, sf_dir, "ocr_raw"), missing=True)))


def response_plain_text(spark, sf_dir):
    b = nested.box_corners(read(spark, sf_dir, "ocr_raw")).withColumn("box_index", F.col("box_no"))
    return envelope.plain_text(b, ["raw_id", "page"])


def canonical_text(spark, sf_dir):
    t = tx.canonical(F.col("text"))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


def restored_text(spark, sf_dir):
    t = tx.restored(tx.canonical(F.col("text")))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(t).alias("digest"))


def filtered_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(tx.without(F.col("text"))).alias("digest"))


def char_tokens(spark, sf_dir):
    t = tx.char_tokens(F.regexp_replace(F.col("text"), "[\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u000b\\u0085\\u001c-\\u001f]", ""))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


def basic_tokens(spark, sf_dir):
    t = tx.basic_tokens(F.col("text"))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(t).alias("tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


def word_pieces(spark, sf_dir):
    """Word pieces over a vocabulary of two-letter pieces."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = {a + b for a in letters for b in letters} | {"##" + a + b for a in letters for b in letters} | {"##" + a for a in letters} | set(letters)
    t = tx.pieces(vocab)(tx.basic_tokens(F.col("text")))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(t).alias("pieces"), F.md5(F.array_join(t, " ")).alias("digest"))


def _characters(spark, sf_dir) -> list[str]:
    """A vocabulary: the unknown token and the letters of the lists (some hundreds at most)."""
    c = read(spark, sf_dir, "gazetteer").select(F.explode(F.split("value", "")).alias("c")).where("c <> ''").distinct()
    return ["[UNK]", *sorted(r["c"] for r in c.collect())]


def token_ids(spark, sf_dir):
    """Hospitals as ids of a vocabulary of characters."""
    known = _characters(spark, sf_dir)
    ids = tx.ids_of(known, "[UNK]")(F.filter(F.split("value", ""), lambda x: x != ""))
    v = _values(spark, sf_dir, "Hospital_Name").select("mention_id", ids.alias("ids"))
    back = F.array_join(tx.tokens_of(F.col("ids"), known), "")
    return v.select("mention_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), back.alias("back"))


def listed_patterns(spark, sf_dir):
    """The first of some thousand patterns, places of the list in their settings, in list order."""
    places = [r["value"] for r in read(spark, sf_dir, "gazetteer").where("list_name = 'place_py'").orderBy("list_pos").select("value").collect()]
    patterns = tx.code_patterns(places, [("FROM ?", ""), ("TO ?", ""), ("", "(?: INTL)?")])
    t = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.first_of_many(patterns)(F.upper("text")).alias("f"))
    return t.where("f.pattern_pos is not null").select("doc_id", "f.pattern_pos", "f.match")


def char_classes(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    c = c.where("c <> ''")
    return c.select("c", "n", tx.is_punctuation(F.col("c")).alias("punctuation"), tx.is_space(F.col("c")).alias("space"), tx.is_han(F.col("c")).alias("han"))


def regex_fields(spark, sf_dir):
    t = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return tx.fields(t, "text", FIELDS).groupBy("category", "value").agg(F.count("*").alias("n"))


def pattern_first_match(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tx.first_pattern(t, "doc_id", "text", FLIGHT_PATTERNS)


def digit_confusions(spark, sf_dir):
    pairs = [("O", "0"), ("I", "1"), ("l", "1"), ("NAR", "MAR"), ("NAY", "MAY"), ("0CT", "OCT"), ("N0V", "NOV")]
    v = read(spark, sf_dir, "mentions").where("category = 'Flight_Date' and value is not null")
    return v.select("mention_id", tx.confusions(F.col("value"), pairs).alias("fixed"))


def _values(spark, sf_dir, *cats):
    return read(spark, sf_dir, "mentions").where(F.col("category").isin(*cats) & F.col("value").isNotNull())


def date_normalize(spark, sf_dir):
    v, c = _values(spark, sf_dir, "Admission_Date", "Discharge_Date", "Check_Date", "Report_Date"), F.col("value")
    return v.select("mention_id", nz.date_run(c).alias("run"), nz.discharge_date(c).alias("discharge"), nz.discharge_date(c, fixed=True).alias("fixed"), nz.imaging_date(c).alias("imaging"))


def flight_date_fix(spark, sf_dir):
    v = _values(spark, sf_dir, "Flight_Date").select("mention_id", nz.flight_date(F.col("value")).alias("fixed"))
    return v.select("mention_id", "fixed", nz.flight_date_iso(F.col("fixed")).alias("iso"))


def number_fix(spark, sf_dir):
    v, c = _values(spark, sf_dir, "Flight_Number", "Admission_Number", "Ticket_Fee", "Total_Fee"), F.col("value")
    return v.select("mention_id", nz.flight_number_cut(c).alias("cut"), nz.admission_number(c).alias("run"), nz.without_letters(c).alias("amount"), nz.is_amount_text(c).alias("is_amount"))


#: Words of the given papers that stand in for carrier names, with codes of theirs.
NAMED = [("航班", "UQ"), ("登机", "QY"), ("FLIGHT", "VJ"), ("改签", "ZX")]


def flight_numbers(spark, sf_dir):
    """Flight numbers completed by a carrier that the document names."""
    v = _with_texts(spark, sf_dir, "Flight_Number")
    value, text = F.replace("value", F.lit(" "), F.lit("")), F.upper("text")
    cut = nz.flight_number_cut(value)
    return v.select("mention_id", nz.flight_number(cut, text).alias("number"), nz.flight_number(F.regexp_replace(cut, "[A-Z]", ""), text, NAMED).alias("completed"))


def names_cut(spark, sf_dir):
    v, c = _values(spark, sf_dir, "Name", "Name_PY"), F.col("value")
    return v.select("mention_id", nz.bracketless(c).alias("bracketless"))


def _syllables(spark, sf_dir) -> list[str]:
    """The syllables in which the place names of the list are spelt: endings after a
    vowel and consonants before one; a list of some hundreds at most."""
    places = read(spark, sf_dir, "gazetteer").where("list_name = 'place_py'").select(F.lower("value").alias("v"))
    found = places.select(F.explode(F.regexp_extract_all("v", F.lit(r"(?:[zcs]h|[bpmfdtnlgkhjqxrzcsyw])?(?:[aeiouv]+)(?:ng|n|r)?(?![aeiouv])"), F.lit(0))).alias("s"))
    return sorted(r["s"] for r in found.where("length(s) <= 6").distinct().collect())


def latin_names(spark, sf_dir):
    """Latin passenger names, found again in their document (no SQL: sequential rules)."""
    v = _with_texts(spark, sf_dir, "Name_PY")
    return v.select("mention_id", nz.passenger_name(_syllables(spark, sf_dir))("value", "text").alias("name"))


def name_syllables(spark, sf_dir):
    """Leading syllables of Latin place names, from the syllables of the list (no SQL: greedy)."""
    s = nz.syllables(_syllables(spark, sf_dir))(F.lower("value"))
    return _values(spark, sf_dir, "Origin_PY", "Destination_PY").select("mention_id", F.array_join(s, "-").alias("syllables"))


def final_values(spark, sf_dir):
    """Every value as its task hands it out (no SQL: it takes in the names' rules)."""
    m = _with_texts(spark, sf_dir, *(c for cs in TASK_CATEGORIES.values() for c in cs))
    places = read(spark, sf_dir, "gazetteer").where("list_name = 'place_py'")
    return values.final_values(m, places, _syllables(spark, sf_dir)).select("mention_id", "final")


def name_context(spark, sf_dir):
    """Names far from the cue word are emptied."""
    v = _with_texts(spark, sf_dir, "Name")
    return v.select("mention_id", nz.name_near(F.col("value"), F.col("text"), cue="日期").alias("name"))


def departments(spark, sf_dir):
    v = _with_texts(spark, sf_dir, "Department")
    return v.select("mention_id", nz.department(F.col("value"), F.col("text")).alias("department"))


def key_values(spark, sf_dir):
    """``key:value`` sheets written from mentions and read again."""
    m = _values(spark, sf_dir, "Flight_Number", "Flight_Date").where("doc_id is not null")
    sheet = m.groupBy("doc_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat("category", F.lit(":"), "value")))).alias("text"))
    return readers.read_key_values(sheet, "doc_id").groupBy("category", "value").agg(F.count("*").alias("n"))


def gazetteer_ratio(spark, sf_dir):
    g = read(spark, sf_dir, "gazetteer").where("list_name = 'place_py'")
    return match.containment_ratio(_with_texts(spark, sf_dir, "Origin_PY", "Destination_PY"), g, "mention_id")


def absent_documents(spark, sf_dir):
    return match.absent(read(spark, sf_dir, "mentions"), read(spark, sf_dir, "ocr_raw"), "doc_id").select("mention_id")


def present_documents(spark, sf_dir):
    return match.present(read(spark, sf_dir, "mentions"), read(spark, sf_dir, "ocr_raw"), "doc_id").groupBy("category").agg(F.count("*").alias("n"))


def low_scored_values(spark, sf_dir):
    """Mentions whose value stands in a badly recognised box of their document."""
    raw = read(spark, sf_dir, "ocr_raw")
    b = nested.box_corners(raw).join(raw.select("raw_id", "doc_id"), "raw_id")
    b = b.withColumn("box_idx", F.col("raw_id") * 1_048_576 + F.col("box_no"))
    m = read(spark, sf_dir, "mentions").where("length(value) >= 4")
    return match.low_scored(m, b, 0.5)


QUERIES = {
    f.__name__: f
    for f in (
        box_geometry, row_group, row_group_font, row_order, row_spacing, layout_text, layout_paragraphs, layout_by_edge, font_size, header_columns, rank_columns,
        fees, ocr_codes, response_plain_text, canonical_text, restored_text, filtered_words, char_tokens, basic_tokens, word_pieces, token_ids, listed_patterns, char_classes,
        regex_fields, pattern_first_match, digit_confusions, date_normalize, flight_date_fix, number_fix, flight_numbers, names_cut, latin_names, name_syllables, final_values, name_context, departments, key_values,
        gazetteer_ratio, absent_documents, present_documents, low_scored_values,
    )
}

_months = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_z = "CASE WHEN length({0}) = 1 THEN '0' || {0} ELSE {0} END"
_p = "'([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})'"


def _iso_sql(v: str, other: str) -> str:
    y, m, d = (f"regexp_extract({v}, {_p}, {i})" for i in (1, 2, 3))
    return f"CASE WHEN {y} <> '' THEN {y} || '-' || {_z.format(m)} || '-' || {_z.format(d)} ELSE {other} END"


def _chain(v: str, pairs) -> str:
    for a, b in pairs:
        v = f"replace({v}, '{a}', '{b}')"
    return v


def _flight_iso_sql(v: str) -> str:
    whens = ""
    for i, m in enumerate(_months):
        after, before = f"substring({v}, instr({v}, '{m}') + 3)", f"substring({v}, 1, instr({v}, '{m}') - 1)"
        whens += f" WHEN contains({v}, '{m}') THEN CASE WHEN {after} <> '' THEN {after} || '-' ELSE '' END || '{i + 1:02d}-' || {before}"
    return f"CASE{whens} ELSE {v} END"


def _column_sql(x: str, left: str, mid: str, right: str, names) -> str:
    before, between, at_mid, rest, beyond = names
    return f"CASE WHEN {left} < {x} AND {x} < {mid} THEN '{between}' WHEN {x} < {left} THEN '{before}' WHEN {x} > {right} THEN '{beyond}' WHEN {x} - {mid} < {right} - {x} THEN '{at_mid}' ELSE '{rest}' END"


def _amount_sql(t: str) -> str:
    shapes = " OR ".join(f"contains(lower({t}), '{x}')" for x in (".0", "0.", ".o", "o."))
    return f"(({shapes}) AND NOT regexp_matches({t}, '[一-龥]') AND NOT contains(lower({t}), 'e-'))"


def _shared_sql(words: str) -> str:
    return " + ".join(f"contains(text, '{c}')::INTEGER" for c in dict.fromkeys(words)).join("()")


def _flight_number_sql(v: str, carriers) -> str:
    whens = " ".join(f"WHEN contains(t, '{n}') AND contains(t, '{c}' || d) THEN '{c}' || d" for n, c in carriers)
    return f"(SELECT CASE WHEN regexp_matches({v}, '[一-龥]') THEN NULL {whens} ELSE {v} END FROM (SELECT regexp_replace({v}, '[^\\p{{Nd}}]', '', 'g') AS d))"


_mention_values = "SELECT mention_id, value FROM mentions WHERE value IS NOT NULL AND category IN ({0})"
_pattern_whens = " ".join(f"WHEN regexp_matches(text, '{p}') THEN {i}" for i, p in enumerate(FLIGHT_PATTERNS))
_match_whens = " ".join(f"WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 0)" for i, p in enumerate(FLIGHT_PATTERNS))
_canon = f"regexp_replace(replace(text, chr(10), '{LINE_BREAK}'), '{SPACE_CLASS}', '', 'g')"

_TOKENS = f"""WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\p{{Cf}}\\x{{fffd}}]', '', 'g'))), '{tx.TOKEN.replace(chr(39), chr(39) * 2)}') AS t FROM documents WHERE text IS NOT NULL)"""

SQL = {
    "box_geometry": f"WITH RECURSIVE {CORNERS} SELECT doc_id, box_idx, min_y, avg_y, x_start, x_end, x_center, height FROM geo",
    "row_group": f"WITH RECURSIVE {CORNERS}, {ROWS} SELECT doc_id, box_idx, row_id FROM rws",
    "row_group_font": f"""WITH RECURSIVE {CORNERS}, f1 AS (SELECT *, avg(height) OVER (PARTITION BY doc_id ORDER BY box_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f,
  lead(box_idx) OVER (PARTITION BY doc_id ORDER BY box_idx) IS NULL AS last FROM geo),
f2 AS (SELECT *, CASE WHEN last THEN coalesce(lag(f) OVER (PARTITION BY doc_id ORDER BY box_idx), f) ELSE f END AS font, lag(avg_y) OVER (PARTITION BY doc_id ORDER BY box_idx) AS prev FROM f1)
SELECT doc_id, box_idx, sum(CASE WHEN avg_y >= prev + font THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY box_idx)::BIGINT AS row_id FROM f2""",
    "row_order": f"WITH RECURSIVE {CORNERS}, {ROWS}, {ORDERED} SELECT doc_id, box_idx, row_id, row_pos FROM ord",
    "row_spacing": f"WITH RECURSIVE {CORNERS}, {ROWS}, {ORDERED} SELECT doc_id, box_idx, n_blanks FROM spc",
    "layout_text": f"""WITH RECURSIVE {CORNERS}, {ROWS}, {ORDERED}, n AS (SELECT doc_id, count(*) AS n FROM geo GROUP BY doc_id)
SELECT doc_id, string_agg(text || chr(10), '' ORDER BY row_id) AS text FROM txt JOIN n USING (doc_id) WHERE n >= 3 GROUP BY doc_id
UNION ALL SELECT doc_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY box_idx) FROM geo JOIN n USING (doc_id) WHERE n < 3 GROUP BY doc_id""",
    "layout_paragraphs": f"""WITH RECURSIVE {CORNERS}, {ROWS}, {ORDERED}, e AS (SELECT *, max(x_end) OVER (PARTITION BY doc_id) - x_end >= 2 * font AS ends FROM txt)
SELECT doc_id, string_agg(text || CASE WHEN ends THEN chr(10) ELSE '' END, '' ORDER BY row_id) AS text FROM e GROUP BY doc_id""",
    "layout_by_edge": f"""WITH RECURSIVE {CORNERS}, {ROWS}, {ORDERED}, e AS (SELECT *, max(x_end) OVER (PARTITION BY doc_id) - x_end >= 2 * font AS ends FROM txt),
p AS (SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS para FROM e)
SELECT doc_id, row_id, para, (row_number() OVER (PARTITION BY doc_id, para ORDER BY x_end, row_id) - 1)::INTEGER AS para_pos FROM p QUALIFY max(ends::INTEGER) OVER (PARTITION BY doc_id, para) = 1""",
    "font_size": f"WITH RECURSIVE {CORNERS} SELECT doc_id, round(avg(height), 6) AS font_size FROM geo GROUP BY doc_id",
    "header_columns": f"""WITH RECURSIVE {CORNERS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY box_idx) AS r FROM geo),
h AS (SELECT doc_id, max(ax) FILTER (WHERE r = 1) AS l, max(ax) FILTER (WHERE r = 2) AS m, max(ax) FILTER (WHERE r = 3) AS e FROM o GROUP BY doc_id)
SELECT doc_id, box_idx, text, {_column_sql('ax', 'l', 'm', 'e', ('before', 'between', 'at_mid', 'rest', 'beyond'))} AS column_name FROM o JOIN h USING (doc_id) WHERE r > 3""",
    "rank_columns": f"""WITH RECURSIVE {CORNERS}
SELECT doc_id, box_idx, text, ['first', 'second', 'third', 'fourth', 'fifth'][row_number() OVER (PARTITION BY doc_id ORDER BY x_center, box_idx)] AS column_name FROM geo QUALIFY count(*) OVER (PARTITION BY doc_id) = 5""",
    "fees": f"""WITH RECURSIVE {CORNERS}, k AS (SELECT *, {_amount_sql('text')} AS fee, {', '.join(f"{_shared_sql(w)} >= {n} AS h{i}" for i, (w, n) in enumerate(HEADS))} FROM geo WHERE text IS NOT NULL),
w AS (SELECT *, {', '.join(f"arg_max(ax, box_idx) FILTER (WHERE h{i}) OVER (PARTITION BY doc_id) AS a{i}" for i in range(3))}, count(*) FILTER (WHERE fee) OVER (PARTITION BY doc_id) AS n FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ax, box_idx) AS r FROM w WHERE fee AND a0 IS NOT NULL AND a1 IS NOT NULL AND a2 IS NOT NULL)
SELECT doc_id, box_idx, CASE WHEN n = 5 THEN {list(layout.FEES)}[r] ELSE {_column_sql('ax', 'a0', 'a1', 'a2', layout.FEES)} END AS category, regexp_replace(text, '[A-Za-z ]', '', 'g') AS value FROM f""",
    "response_plain_text": f"""WITH RECURSIVE {CORNERS} SELECT raw_id, page, string_agg(coalesce(text, '') || chr(10), '' ORDER BY box_idx) AS text FROM crn GROUP BY raw_id, page""",
    "ocr_codes": f"""WITH RECURSIVE {PAYLOAD}, r AS (SELECT o.raw_id, coalesce(x ->> '$.error', '') AS error, coalesce(r ->> '$.message', '') AS message, x ->> '$.error' IS NULL AND r ->> '$.message' IS NULL AS missing
  FROM (SELECT raw_id, page, l[page + 1] AS x, CASE WHEN json_type(l[page + 1]) = 'OBJECT' THEN CASE json_type(l[page + 1], '$.result') WHEN 'VARCHAR' THEN CASE WHEN json_valid(l[page + 1] ->> '$.result') THEN (l[page + 1] ->> '$.result')::JSON END ELSE l[page + 1] -> '$.result' END END AS r
    FROM (SELECT raw_id, l, unnest(range(len(l))) AS page FROM lists)) q RIGHT JOIN ocr_raw o USING (raw_id) WHERE q.raw_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM lists l WHERE l.raw_id = o.raw_id AND len(l.l) = 0)),
c AS (SELECT CASE WHEN missing THEN '10002' WHEN message <> 'success' OR error <> '' THEN '10006' ELSE '200' END AS code FROM r)
SELECT code, count(*) AS responses FROM c WHERE code <> '200' GROUP BY code""",
    "canonical_text": f"SELECT doc_id, length({_canon})::INTEGER AS n, md5({_canon}) AS digest FROM documents WHERE text IS NOT NULL",
    "restored_text": f"SELECT doc_id, md5(replace({_canon}, '{LINE_BREAK}', chr(10))) AS digest FROM documents WHERE text IS NOT NULL",
    "filtered_words": "SELECT doc_id, md5(translate(text, '。【】', '')) AS digest FROM documents WHERE text IS NOT NULL",
    "char_tokens": f"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b\\x{{0085}}\\x1c-\\x1f]', '', 'g'), '(?i){LINE_BREAK}|\\S') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(t)::INTEGER AS tokens, len(list_distinct(t))::INTEGER AS distinct_tokens FROM t""",
    "basic_tokens": f"""{_TOKENS} SELECT doc_id, len(t)::INTEGER AS tokens, md5(array_to_string(t, ' ')) AS digest FROM t""",
    "word_pieces": f"""{_TOKENS}, p AS (SELECT doc_id, flatten(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[a-z]{{1,200}}$')
  THEN list_transform(range((length(x) + 1) // 2), lambda i: CASE WHEN i > 0 THEN '##' ELSE '' END || substring(x, 2 * i + 1, 2)) ELSE ['[UNK]'] END)) AS p FROM t)
SELECT doc_id, len(p)::INTEGER AS pieces, md5(array_to_string(p, ' ')) AS digest FROM p""",
    "token_ids": """WITH k AS (SELECT list_prepend('[UNK]', list_sort(list_distinct(flatten(list(string_split(value, '')))))) AS k FROM gazetteer WHERE value <> ''),
t AS (SELECT mention_id, list_transform(list_filter(string_split(value, ''), lambda x: x <> ''), lambda x: coalesce(list_position(k, x), 1)) AS i, k FROM mentions, k WHERE category = 'Hospital_Name' AND value IS NOT NULL)
SELECT mention_id, array_to_string(list_transform(i, lambda x: x - 1), ' ') AS ids, array_to_string(list_transform(i, lambda x: k[x]), '') AS back FROM t""",
    "listed_patterns": """WITH g AS (SELECT value, row_number() OVER (ORDER BY list_pos) - 1 AS n FROM gazetteer WHERE list_name = 'place_py'),
p AS (SELECT 3 * n AS pattern_pos, 'FROM ?' || value AS p FROM g UNION ALL SELECT 3 * n + 1, 'TO ?' || value FROM g UNION ALL SELECT 3 * n + 2, value || '(?: INTL)?' FROM g),
d AS (SELECT doc_id, upper(text) AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, t, n FROM d JOIN g ON contains(t, value)),
m AS (SELECT doc_id, pattern_pos, regexp_extract(t, p, 0) AS match FROM h JOIN p ON p.pattern_pos // 3 = h.n WHERE regexp_matches(t, p))
SELECT doc_id, pattern_pos::INTEGER AS pattern_pos, match FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pattern_pos) = 1""",
    "char_classes": r"""WITH c AS (SELECT unnest(string_split(text, '')) AS c FROM documents), g AS (SELECT c, count(*) AS n FROM c WHERE c <> '' GROUP BY c)
SELECT c, n, regexp_matches(c, '^[\pP!-/:-@\[-`{-~]$') AS punctuation, c IN (' ', chr(9), chr(10), chr(13)) OR regexp_matches(c, '^\p{Zs}$') AS space, regexp_matches(c, '^[一-鿿㐀-䶿豈-﫿]$') AS han FROM g""",
    "regex_fields": " UNION ALL ".join(
        f"SELECT category, regexp_replace(m, '{label}', '', 'g') AS value, sum(n)::BIGINT AS n FROM (SELECT '{c}' AS category, m, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{p}')) AS m FROM documents) GROUP BY m) GROUP BY ALL"
        for c, (p, label) in FIELDS.items()
    ),
    "pattern_first_match": f"""WITH t AS (SELECT doc_id, text, CASE {_pattern_whens} END AS pattern_pos, CASE {_match_whens} END AS match FROM documents)
SELECT doc_id, pattern_pos, match, replace(text, match, ' ') AS rest FROM t WHERE pattern_pos IS NOT NULL""",
    "digit_confusions": f"SELECT mention_id, {_chain('value', [('O', '0'), ('I', '1'), ('l', '1'), ('NAR', 'MAR'), ('NAY', 'MAY'), ('0CT', 'OCT'), ('N0V', 'NOV')])} AS fixed FROM mentions WHERE category = 'Flight_Date' AND value IS NOT NULL",
    "date_normalize": f"""WITH v AS ({_mention_values.format("'Admission_Date', 'Discharge_Date', 'Check_Date', 'Report_Date'")}),
w AS (SELECT *, CASE WHEN regexp_extract(value, '[\\p{{Nd}}./:：,^年月日时分秒点-]+') <> '' THEN regexp_extract(value, '[\\p{{Nd}}./:：,^年月日时分秒点-]+') ELSE value END AS r, replace(value, '.', '-') AS d, replace(regexp_replace(value, '[年月]', '-', 'g'), '.', '-') AS f,
  regexp_replace(regexp_replace(value, '[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}', '', 'g'), '[年月日./]', '-', 'g') AS i FROM v)
SELECT mention_id, CASE WHEN length(r) <= 2 THEN '' ELSE r END AS run, {_iso_sql('d', 'value')} AS discharge, {_iso_sql('f', 'value')} AS fixed, {_iso_sql('i', 'i')} AS imaging FROM w""",
    "flight_date_fix": f"""WITH v AS ({_mention_values.format("'Flight_Date'")}), c AS (SELECT mention_id, {_chain("replace(value, ' ', '')", [('O', '0'), ('I', '1'), ('T', '1'), ('Q', '0'), ('0C1', 'OCT'), ('N0V', 'NOV'), ('0CT', 'OCT')])} AS c FROM v),
f AS (SELECT mention_id, CASE WHEN regexp_matches(c, '[A-Za-z]') AND NOT regexp_matches(c, '{'|'.join(_months)}') THEN '' ELSE c END AS fixed FROM c), g AS (SELECT *, regexp_replace(fixed, '[ :：.]', '-', 'g') AS v FROM f)
SELECT mention_id, fixed, {_flight_iso_sql('v')} AS iso FROM g""",
    "number_fix": f"""WITH v AS ({_mention_values.format("'Flight_Number', 'Admission_Number', 'Ticket_Fee', 'Total_Fee'")})
SELECT mention_id, substring(replace(value, ' ', ''), 1, 6) AS cut,
  CASE WHEN regexp_extract(value, '[\\p{{Nd}}A-Za-z+-]+') <> '' THEN regexp_extract(value, '[\\p{{Nd}}A-Za-z+-]+') ELSE value END AS run, regexp_replace(value, '[A-Za-z ]', '', 'g') AS amount, {_amount_sql('value')} AS is_amount FROM v""",
    "flight_numbers": f"""WITH RECURSIVE {TEXTS}, v AS (SELECT mention_id, substring(replace(value, ' ', ''), 1, 6) AS v, upper(coalesce(text, '')) AS t FROM mentions LEFT JOIN dtx USING (doc_id) WHERE category = 'Flight_Number' AND value IS NOT NULL),
w AS (SELECT *, regexp_replace(v, '[A-Z]', '', 'g') AS u FROM v)
SELECT mention_id, {_flight_number_sql('v', nz.CARRIERS)} AS number, {_flight_number_sql('u', NAMED)} AS completed FROM w""",
    "names_cut": f"""WITH v AS ({_mention_values.format("'Name', 'Name_PY'")}) SELECT mention_id, CASE WHEN length(value) = 1 THEN '' ELSE regexp_replace(value, '\\(.+\\)', '', 'g') END AS bracketless FROM v""",
    "name_context": f"""WITH RECURSIVE {TEXTS}, f AS (SELECT mention_id, value AS v, coalesce(text, '') AS text FROM mentions LEFT JOIN dtx USING (doc_id) WHERE category = 'Name' AND value IS NOT NULL),
g AS (SELECT *, greatest(instr(text, v) - 1 - 50, 0) AS s FROM f)
SELECT mention_id, CASE WHEN contains(text, '日期') AND NOT contains(substring(text, (s + 1)::BIGINT, length(v) + 100), '日期') THEN '' ELSE v END AS name FROM g""",
    "departments": f"""WITH RECURSIVE {TEXTS}, f AS (SELECT mention_id, value, CASE WHEN instr(text, value) > 0 THEN substring(text, instr(text, value) + length(value), 3) ELSE '' END AS tail FROM mentions LEFT JOIN dtx USING (doc_id) WHERE category = 'Department' AND value IS NOT NULL)
SELECT mention_id, replace(value || CASE WHEN left(tail, 1) IN (')', '）') THEN ')' ELSE '' END || CASE WHEN left(tail, 2) = '住院' AND tail <> '住院号' THEN '住院' ELSE '' END, '料', '科') AS department FROM f""",
    "key_values": r"""WITH m AS (SELECT category, unnest(CASE WHEN category = 'Flight_Number' THEN string_split(upper(replace(value, ' ', '')), ',') ELSE [upper(replace(value, ' ', ''))] END) AS value
FROM mentions WHERE category IN ('Flight_Number', 'Flight_Date') AND value IS NOT NULL AND doc_id IS NOT NULL)
SELECT category, value, count(*) AS n FROM m WHERE value <> '' GROUP BY ALL""",
    "gazetteer_ratio": f"""WITH RECURSIVE {TEXTS}, v AS (SELECT mention_id, value, coalesce(text, '') AS text FROM mentions LEFT JOIN dtx USING (doc_id) WHERE category IN ('Origin_PY', 'Destination_PY') AND length(value) > 3 AND NOT contains(value, 'GATE') AND NOT contains(value, 'PLEASE')),
g AS (SELECT list_pos, value AS entry FROM gazetteer WHERE list_name = 'place_py')
SELECT mention_id, value, list_pos, entry FROM v JOIN g ON (contains(value, entry) AND length(entry)::DOUBLE / length(value) >= 0.6) OR (NOT contains(value, entry) AND contains(entry, value) AND length(value)::DOUBLE / length(entry) >= 0.5 AND contains(text, entry))
QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY (entry <> value)::INTEGER, list_pos) = 1""",
    "absent_documents": "SELECT mention_id FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM ocr_raw o WHERE o.doc_id = m.doc_id)",
    "present_documents": "SELECT category, count(*) AS n FROM mentions m WHERE EXISTS (SELECT 1 FROM ocr_raw o WHERE o.doc_id = m.doc_id) GROUP BY category",
    "low_scored_values": f"""WITH RECURSIVE {CORNERS}, m AS (SELECT mention_id, doc_id, string_split(value, '-')[-1] AS part FROM mentions WHERE length(value) >= 4),
j AS (SELECT mention_id, raw_id * 1048576 + box_idx AS box_idx, score FROM m JOIN ocr_raw USING (doc_id) JOIN (SELECT raw_id, box_idx, text, score FROM crn) USING (raw_id) WHERE part <> '' AND contains(text, part)),
f AS (SELECT mention_id, score, box_idx FROM j QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY box_idx) = 1)
SELECT mention_id, score, box_idx FROM f WHERE score < 0.5""",
}
