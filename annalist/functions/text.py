"""Text functions as columns: normalising, tokens, overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a question, and words that carry no topic of a query.
QUESTION_STARTERS = """
what why how when where who which is are am do does did can could would should will have has tell explain summarize remind check
""".split()
STOP_WORDS = tuple(QUESTION_STARTERS) + tuple("""
a an and about all any be been being currently current for from get give had i in it just know me my now of on or our please
remember session something talk talked talking that the them this those to us we were with you your
""".split())


def normalise(text: Column) -> Column:
    """Runs of ASCII white space become one blank, ends are trimmed, letters lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\x0b\\f]+", " ")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_']+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def content_set(text: Column) -> Column:
    return F.filter(token_set(text), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up by floor, alike in every engine."""
    p = float(10**digits)
    return F.floor(x * F.lit(p) + F.lit(0.5)) / F.lit(p)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def topical(content: Column, lexical: Column, content_needed: Column) -> Column:
    """Content overlap leads; without any, a lexical match counts a tenth where the query has content, else fully."""
    return F.when(content_needed & (content <= 0), lexical * 0.1).when(content > 0, F.greatest(content, lexical * 0.5)).otherwise(lexical)
