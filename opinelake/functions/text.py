"""Text cleaning and tokenising as native column expressions (no Python UDF)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add, or_
from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns. ``(?U)`` gives the Unicode meaning of \s, \S and \w; after the
# ASCII step the plain classes are enough.
HTML_TAG = r"<[^>]+>"
URL = r"(?U)(?:http|www\.)\S+"
# From the start of a run of non-spaces, so that a long word is walked through once.
EMAIL = r"(?U)(?<!\S)\S[^\s@]*+@\S+"
MENTION = r"(?U)@\w+"
HASHTAG = r"(?U)#(\w+)"
NON_ASCII = r"[^\x00-\x7F]"
PUNCTUATION = r"[^\w\s']"
DIGITS = r"\d+"
SPACES = r"\s+"
NO_WORD = r"[^\w']+"
# Letters one by one: Java tests such a class by one table, ranges one after the other.
NO_LETTER = rf"[^{ascii_letters}_']+"
UNICODE_SPACES = r"(?U)\s+"
SENTENCE_END = r"[.!?]+"
TREND_WORD = r"\b([a-z]{3,})\b"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _where(text: Column, marks: Sequence[str], step: Callable[[Column], Column]) -> Column:
    """``step`` over the texts that hold one of its marks; it would leave the others as they are, but walk through them."""
    return F.element_at(F.transform(F.array(text), lambda t: F.when(contains_any(t, marks), step(t)).otherwise(t)), 1)


def strip_html(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), HTML_TAG, " ")


def strip_urls(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), URL, " ")


def strip_emails(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), EMAIL, " ")


def strip_mentions(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), MENTION, " ")


def unwrap_hashtags(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), HASHTAG, "$1")


def ascii_only(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), NON_ASCII, "")


def punctuation_to_space(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), PUNCTUATION, " ")


def digits_to_space(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), DIGITS, " ")


def squeeze_lower(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(as_col(c), SPACES, " ")))


def clean_text(c: Column | str) -> Column:
    """Review cleaning; null becomes the empty string.

    Punctuation to space and squeezing are one pass: both only merge what is neither a word
    character nor an apostrophe.
    """
    text = F.coalesce(as_col(c).cast("string"), F.lit(""))
    for marks, step in ((["<"], strip_html), (["http", "www."], strip_urls), (["@"], strip_emails)):
        text = _where(text, marks, step)
    return F.lower(F.trim(F.regexp_replace(ascii_only(text), NO_WORD, " ")))


def clean_tweet_text(c: Column | str) -> Column:
    """Tweet cleaning; mentions go before e-mails, so ``a@b.com`` leaves ``a com``."""
    text = F.coalesce(as_col(c).cast("string"), F.lit(""))
    steps = ((["<"], strip_html), (["http", "www."], strip_urls), (["@"], strip_mentions), (["#"], unwrap_hashtags), (["@"], strip_emails))
    for marks, step in steps:
        text = _where(text, marks, step)
    return F.lower(F.trim(F.regexp_replace(ascii_only(text), NO_LETTER, " ")))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and whitespace-only text."""
    return ~F.coalesce(as_col(c).rlike(r"(?U)\S"), F.lit(False))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space (``trim`` only removes the plain space)."""
    return F.regexp_replace(as_col(c), r"(?U)^\s+|\s+$", "")


def tokens(c: Column | str, longer_than: int = 0) -> Column:
    """Lower-cased whitespace tokens with more than ``longer_than`` characters."""
    words = F.split(F.lower(as_col(c)), UNICODE_SPACES)
    return F.filter(words, lambda w: F.length(w) > longer_than)


def trend_words(c: Column | str) -> Column:
    """All words of three or more ASCII letters."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(TREND_WORD), 1)


def sentences(c: Column | str) -> Column:
    return F.split(as_col(c), SENTENCE_END)


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases]) if phrases else F.lit(False)


def containment_count(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur in the text (each at most once)."""
    return reduce(add, [F.contains(text, F.lit(p)).cast("int") for p in phrases]) if phrases else F.lit(0)


def contained_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur in the text, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases]))


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(as_col(c), 1, n)


def aspect_slug(c: Column | str) -> Column:
    return F.replace(F.lower(as_col(c)), F.lit(" "), F.lit("_"))


def topic_title(c: Column | str) -> Column:
    return F.initcap(F.replace(as_col(c), F.lit("_"), F.lit(" ")))
