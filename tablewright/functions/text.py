"""Text expressions: whitespace, null tokens, comparison keys, letter case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing cell (compared in lower case, after trimming).
NULL_TOKENS = ("", "na", "n/a", "null", "none", "nan", "nat", "missing")

# Every character that counts as white space at the ends of a cell.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (SQL ``trim`` removes blanks only).

    Searching each end among all white space is slow; a text that begins and ends with a visible ASCII character is left
    alone after two comparisons of bytes.
    """
    last = F.substring(c, -1, 1)
    visible = (c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(visible, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def token_to_null(trimmed: Column, tokens=NULL_TOKENS) -> Column:
    """NULL for a trimmed text that means "missing". Longer texts are not even lower-cased."""
    longest = max(len(t.encode()) for t in tokens)
    return F.when((F.octet_length(trimmed) > longest) | ~F.lower(trimmed).isin(*tokens), trimmed)


def null_tokens_to_null(c: Column, tokens=NULL_TOKENS) -> Column:
    """Trim a text and turn the tokens that mean "missing" into NULL; other texts keep their case."""
    return token_to_null(strip(c), tokens)


def compare_text(c: Column) -> Column:
    """The form in which two texts count as the same value."""
    return F.lower(strip(c))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, also after quotes, hyphens and digits."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def text_mode(c: Column, mode: str = "strip") -> Column:
    """Normalise a categorical text as ``strip``, ``lower`` or ``title``."""
    trimmed = strip(c)
    if mode == "lower":
        return F.lower(trimmed)
    if mode == "title":
        return title_case(trimmed)
    return trimmed
