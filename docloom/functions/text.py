"""Text as columns: canonical blanks, tokens, fields by pattern, character classes."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.schemas import LINE_BREAK

HAN = "一-鿿"
SPACES = r"[\s   -     　]"


def canonical(text: Column) -> Column:
    """Newlines as the line-break word, all other white space removed."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(LINE_BREAK)), SPACES, "")


def restored(text: Column) -> Column:
    """The line-break word, in any case, back to newlines."""
    return F.regexp_replace(text, f"(?i){LINE_BREAK}", "\n")


def without(text: Column, characters: str = "。【】") -> Column:
    """Without the given characters."""
    return F.translate(text, characters, "")


def char_tokens(text: Column) -> Column:
    """Every non-blank character a token; the line-break word, in any case, one too."""
    return F.regexp_extract_all(text, F.lit(f"(?i)({LINE_BREAK}|\\S)"), F.lit(1))


#: Ideographs that are tokens of their own, and punctuation (fixed values).
IDEOGRAPHS = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2ceaf}\x{2f800}-\x{2fa1f}"
PUNCTUATION = r"\p{P}!-/:-@\[-`{-~"
TOKEN = rf"[{IDEOGRAPHS}]|[{PUNCTUATION}]|[^\s\p{{Z}}{IDEOGRAPHS}{PUNCTUATION}]+"


def cleaned(text: Column) -> Column:
    """Without control and format characters and the replacement character; white
    space stays."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}\x{fffd}&&[^\t\n\r]]", "")


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Decomposed and without combining marks."""
    return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"), na_action="ignore")


def basic_tokens(text: Column, lower: bool = True) -> Column:
    """Cleaned, in small letters without accents (unless not ``lower``), parted at white
    space, ideographs and punctuation."""
    t = cleaned(text)
    if lower:
        t = F.lower(t)
        # only texts with letters that may carry marks go through Python
        t = F.coalesce(strip_accents(F.when(t.rlike(r"[\x{c0}-\x{2af}\x{300}-\x{36f}\x{370}-\x{1fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}]"), t)), t)
    return F.regexp_extract_all(t, F.lit(f"({TOKEN})"), F.lit(1))


def is_punctuation(c: Column) -> Column:
    """Unicode punctuation; all ASCII symbols count as such."""
    return c.rlike(r"^[\p{P}!-/:-@\[-`{-~]$")


def is_control(c: Column) -> Column:
    """Control or format character other than tab, newline and carriage return."""
    return c.rlike(r"^[\p{Cc}\p{Cf}]$") & ~c.isin("\t", "\n", "\r")


def is_space(c: Column) -> Column:
    return c.isin(" ", "\t", "\n", "\r") | c.rlike(r"^\p{Zs}$")


def is_han(c: Column) -> Column:
    return c.rlike(f"^[{HAN}㐀-䶿豈-﫿]$")


def pieces(vocabulary: set[str], unknown: str = "[UNK]", longest: int = 200):
    """A column function: greedy longest-match word pieces (``##`` within a word)."""

    def one(words):
        out = []
        for w in words:
            if len(w) > longest:
                out.append(unknown)
                continue
            found, at = [], 0
            while at < len(w):
                end = len(w)
                while end > at and ("##" * (at > 0) + w[at:end]) not in vocabulary:
                    end -= 1
                if end == at:
                    found = [unknown]
                    break
                found.append("##" * (at > 0) + w[at:end])
                at = end
            out.extend(found)
        return out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: None if t is None else one(t))

    return split


def full_tokens(text: Column, vocabulary: list[str], lower: bool = True, unknown: str = "[UNK]", characters: bool = False) -> Column:
    """Basic tokens (or, with ``characters``, single characters with the line-break word
    whole) cut into the word pieces of a vocabulary."""
    return pieces(set(vocabulary), unknown)(char_tokens(text) if characters else basic_tokens(text, lower))


def vocabulary_of(text: str) -> list[str]:
    """The entries of a vocabulary file in order, one a line; the place is the id. Of
    equal lines the last counts when ids are looked up, as the file says so later."""
    lines = text.split("\n")
    return [x.strip() for x in (lines[:-1] if lines[-1] == "" else lines)]


def ids_of(vocabulary: list[str], unknown: str | None = None):
    """A column function: tokens to their ids. A token that is not listed has the id of
    ``unknown``; without one it is an error, as silence would shift all that follows."""
    place = {t: i for i, t in enumerate(vocabulary)}
    other = place[unknown] if unknown is not None else None

    def one(tokens):
        if tokens is None:
            return None
        if other is None:
            return [place[t] for t in tokens]
        return [place.get(t, other) for t in tokens]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def look_up(tokens: pd.Series) -> pd.Series:
        return tokens.map(one)

    return look_up


def tokens_of(ids: Column, vocabulary: list[str]) -> Column:
    """Ids back to tokens."""
    listed = F.array(*map(F.lit, vocabulary)) if len(vocabulary) <= 200 else F.split(F.lit("\n".join(vocabulary)), "\n")
    return F.transform(ids, lambda i: F.element_at(listed, i + 1))


def _required(pattern: str) -> str:
    """The longest literal that every match of ``pattern`` holds; empty if none is sure."""
    from re import _parser as parser

    runs, run = [""], ""

    def walk(items) -> None:
        nonlocal run
        for op, value in items:
            if op is parser.LITERAL:
                run += chr(value)
            elif op is parser.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif op is not parser.AT:
                runs.append(run)
                run = ""

    walk(parser.parse(pattern))
    return max([*runs, run], key=len)


@lru_cache(maxsize=4)
def _dictionary(patterns: tuple[str, ...], ignore_case: bool):
    """``(automaton of the literals or None, compiled patterns, those without a literal)``,
    made once a worker."""
    import ahocorasick

    literals = [_required(p).lower() if ignore_case else _required(p) for p in patterns]
    of: dict[str, list[int]] = {}
    for i, x in enumerate(literals):
        if x:
            of.setdefault(x, []).append(i)
    automaton = ahocorasick.Automaton() if of else None
    for x, places in of.items():
        automaton.add_word(x, places)
    if of:
        automaton.make_automaton()
    return automaton, [re.compile(p, re.I if ignore_case else 0) for p in patterns], [i for i, x in enumerate(literals) if not x]


FIRST = T.StructType([T.StructField("pattern_pos", T.IntegerType()), T.StructField("match", T.StringType())])


def first_of_many(patterns: list[str], ignore_case: bool = False):
    """A column function: the first pattern *in list order* that matches a text, for lists
    of thousands.

    One automaton over a literal of each pattern tells which patterns can match a text
    at all; only those, and patterns without a literal, are tried, in order."""
    listed = tuple(patterns)

    def one(text):
        if text is None:
            return None
        automaton, compiled, always = _dictionary(listed, ignore_case)
        able = set(always)
        if automaton is not None:
            for _, places in automaton.iter(text.lower() if ignore_case else text):
                able.update(places)
        for i in sorted(able):
            m = compiled[i].search(text)
            if m:
                return {"pattern_pos": i, "match": m[0]}
        return None

    @F.pandas_udf(FIRST)
    def search(text: pd.Series) -> pd.DataFrame:
        found = [one(t) or {"pattern_pos": None, "match": None} for t in text]
        return pd.DataFrame({"pattern_pos": pd.array([f["pattern_pos"] for f in found], dtype="Int32"), "match": [f["match"] for f in found]})

    return search


def code_patterns(codes: list[str], affixes: list[tuple[str, str]]) -> list[str]:
    """Every code between every pair of prefix and suffix, codes first."""
    return [before + c + after for c in codes for before, after in affixes]


def fields(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Fields by pattern: ``(..., category, value)``, one row per match.

    ``patterns`` maps a category to the pattern of label and value and to the
    pattern of label words, which are deleted from the match."""
    parts = None
    for category, (pattern, label) in patterns.items():
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        one = df.select("*", F.lit(category).alias("category"), F.explode(found).alias("__m"))
        one = one.withColumn("value", F.regexp_replace("__m", label, "")).drop("__m")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def first_pattern(df: DataFrame, key: str, text: str, patterns: list[str]) -> DataFrame:
    """The first pattern *in list order* that matches: ``(key, pattern_pos, match, rest)``.

    ``rest`` is the text with the match blanked. One combined alternation sorts
    out texts that match nothing before the patterns are tried in turn."""
    t = F.col(text)
    some = df.where(t.rlike("|".join(f"(?:{p})" for p in patterns)))
    pos = F.coalesce(*[F.when(t.rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    match = F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 0)) for p in patterns])
    out = some.select(F.col(key), pos.alias("pattern_pos"), match.alias("match"), t.alias("__t"))
    return out.select(key, "pattern_pos", "match", F.replace("__t", F.col("match"), F.lit(" ")).alias("rest"))


def confusions(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements made one after the other, in order."""
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def shared_characters(a: Column, b: Column) -> Column:
    """Number of distinct characters that two texts share (blanks aside)."""
    chars = lambda x: F.filter(F.array_distinct(F.split(x, "")), lambda c: F.trim(c) != "")
    return F.size(F.array_intersect(chars(a), chars(b)))


def label_type(label: Column) -> Column:
    """The type of a position tag, without its ``B- I- O- S- E-`` prefix."""
    return F.regexp_replace(label, "^[BIOSE]-", "")
