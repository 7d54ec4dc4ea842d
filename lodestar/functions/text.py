"""Tokenising as column expressions: a handful of regular expressions over the whole text, then one split.

The steps and their order define the terms of an index, so documents and queries go through the same function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term has fewer bytes than this.
MAX_TERM_BYTES = 64
#: Stands for a word that trimming left empty, until the split; no other non-ASCII character gets so far.
_EMPTY = "\ue000"

#: Common English function words, the default of the optional stopword step.
STOPWORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both "
    "but by can could did do does doing down during each few for from further had has have having he her here hers him "
    "his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our "
    "ours out over own same she should so some such than that the their theirs them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with would you your yours"
).split()


def normalise(text: Column) -> Column:
    """Words separated by single spaces U+0020, as they will be terms.

    Line breaks count as spaces. Then in this order: tags become spaces, ASCII punctuation becomes spaces, all goes to
    lower case; words that hold a non-ASCII character or have MAX_TERM_BYTES bytes or more disappear; characters up to
    U+0020 are trimmed from both ends of a word; runs of one character that is no digit are cut to two. The time is
    linear in the length of the text: each pattern begins at a word's first character only, and takes back nothing.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]", " ")
    tail = F.substring_index(t, ">", -1)  # no tag ends there, so no bracket in it is looked at
    t = F.concat(F.regexp_replace(F.left(t, F.length(t) - F.length(tail)), r"<[^>]++>", " "), tail)
    t = F.regexp_replace(t, r"\p{Punct}", " ")
    t = F.lower(t)
    t = F.regexp_replace(t, r"(?<![^ ])[\x00-\x1F\x21-\x7F]*+[^\x00-\x7F][^ ]*+", " ")
    t = F.regexp_replace(t, rf"(?<![^ ])[^ ]{{{MAX_TERM_BYTES},}}+", " ")
    trimmed = F.regexp_replace(t, r"(?<![^ ])[\x00-\x1F]++(?![^ ])", _EMPTY)
    trimmed = F.regexp_replace(trimmed, r"(?<![^ ])[\x00-\x1F]++|(?<![\x00-\x1F])[\x00-\x1F]++(?![^ ])", "")
    t = F.when(t.rlike(r"[\x00-\x1F]"), trimmed).otherwise(t)
    return F.regexp_replace(t, r"([^0-9 ])\1{2,}", "$1$1")


def tokens(text: Column) -> Column:
    """The terms of a text in order; null and empty texts have none. A word of control characters alone is an empty
    term and counts."""
    words = F.array_remove(F.split(normalise(text), " "), "")
    return F.when(F.array_contains(words, _EMPTY), F.transform(words, lambda w: F.when(w == _EMPTY, "").otherwise(w))).otherwise(words)


def exploded(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), term."""
    return df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def without_stopwords(terms: DataFrame, stop: DataFrame) -> DataFrame:
    """The rows whose term is no stopword; `stop` has a column word. Duplicates stay."""
    return terms.join(stop.select(F.col("word").alias("term")).distinct(), "term", "left_anti")


def is_conjunctive(query: Column) -> Column:
    """Whether a query asks for all of its terms: it begins with a plus."""
    return F.coalesce(F.trim(query).startswith("+"), F.lit(False))
