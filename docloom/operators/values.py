"""Values as they are handed out: each task sends each category through its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import normalize as nz
from docloom.operators import match


def final_values(mentions: DataFrame, places: DataFrame, known: list[str], iso_dates: bool = False) -> DataFrame:
    """Adds ``final``, the value handed out, null where there is none.

    ``mentions`` has ``mention_id, task, category, value, pred_type`` and ``text``, the text
    of the document; ``places`` is the list of Latin place names, ``known`` the
    syllables of spelt names. Rules by task:

    * all: flight numbers lose blanks and end at six characters, flight dates are
      corrected (and written year first with ``iso_dates``);
    * boarding cards: one character is nothing; Latin names (those of the interface only
      lose plus signs), Latin places by the list, flight numbers, names near their cue;
    * itineraries: amounts lose letters; with codes, names lose brackets and Latin ones
      are cut, and flight numbers are completed;
    * discharge records: dates, admission numbers, hospitals, departments;
    * others stay as they are.

    Null values stay null. The places are one join, everything else is one projection."""
    text = F.replace(F.upper(F.coalesce("text", F.lit(""))), F.lit("^"), F.lit(""))
    category, task = F.col("category"), F.col("task")
    dated = nz.flight_date(F.col("value"))
    if iso_dates:
        dated = F.when(dated == "", dated).otherwise(nz.flight_date_iso(dated))
    first = F.when(category == "Flight_Number", nz.flight_number_cut(F.col("value"))).when(category == "Flight_Date", dated).otherwise(F.col("value"))
    m = mentions.withColumns({"__v": first, "__t": text})
    v, t = F.col("__v"), F.col("__t")

    is_place = (task == "boardcards") & category.isin("Destination_PY", "Origin_PY")
    asked = m.where(is_place).select("mention_id", v.alias("value"), t.alias("text"))
    listed = match.containment_ratio(asked, places, "mention_id").select("mention_id", F.col("entry").alias("__place"))
    m = m.join(listed, "mention_id", "left")

    # the names' rules run in Python: other values reach them as nulls
    bare = nz.bracketless(v)
    spelt = ((task == "boardcards") & (category == "Name_PY") & ~F.coalesce(F.col("pred_type") == "interface", F.lit(False))) | ((task == "xingchengdan_3code") & (category == "Name") & bare.rlike("[a-zA-Z]"))
    m = m.withColumn("__name", nz.passenger_name(known)(F.when(spelt & (F.length(v) > 1), F.when(task == "boardcards", v).otherwise(bare)), F.when(spelt, t)))

    cards = (
        F.when(F.length(v) <= 1, F.lit(None)).when(spelt, F.col("__name")).when(category == "Name_PY", F.replace(v, F.lit("+"), F.lit("")))
        .when(is_place, F.col("__place")).when(category == "Flight_Number", nz.flight_number(v, t)).when(category == "Name", nz.name_near(v, t)).otherwise(v)
    )
    coded = F.when(category == "Flight_Number", nz.flight_number(v, t)).when(spelt, F.col("__name")).when(category == "Name", bare).otherwise(v)
    discharge = (
        F.when(category.contains("Date"), nz.date_run(v)).when(category == "Admission_Number", nz.admission_number(v))
        .when(category == "Hospital_Name", F.when(F.length(v) <= 1, F.lit("")).otherwise(v)).when(category == "Department", nz.department(v, t)).otherwise(v)
    )
    final = (
        F.when(task == "boardcards", cards).when(task == "xingchengdan_3code", coded).when(task == "discharge_records", discharge)
        .when((task == "xingchengdan") & category.contains("Fee"), F.regexp_replace(v, "[a-zA-Z]", "")).otherwise(v)
    )
    return m.withColumn("final", final).drop("__v", "__t", "__place", "__name")
