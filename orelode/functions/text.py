"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of letters and digits, with inner dots, underscores and hyphens: a fixed value.
TOKEN = "[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*"


def tokens(text: Column) -> Column:
    """Lower-cased words in order; a word with separators is followed by its parts. None of a null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(words, lambda t: F.when(t.rlike("[._-]"), F.concat(F.array(t), F.split(t, "[._-]"))).otherwise(F.array(t))))


def counted(items: Column) -> Column:
    """An array as (term, tf) structs by term: sorts and counts runs within the row, without a shuffle."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.element_at(F.transform(F.array(starts), lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("tf")))), 1)

    sorted_items = F.sort_array(items)
    return F.when(F.size(items) == 0, F.array().cast("array<struct<term:string,tf:int>>")).otherwise(F.element_at(F.transform(F.array(sorted_items), runs), 1))


def first_seen(items: Column) -> Column:
    """Distinct non-empty members in the order of their first place."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


#: White space that is cut from both ends of a value, not blanks alone.
WHITE = " \t\n\r\f\u000b\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(WHITE))


def folded(text: Column) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(stripped(text))


def one_space(text: Column) -> Column:
    """White space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
