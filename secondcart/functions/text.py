"""Review text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when a text is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def consolidated_text(title: Column, message: Column) -> Column:
    """Title and message joined by a blank and stripped; NULL when nothing is left."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(message, F.lit("")))
    return F.nullif(F.btrim(joined, F.lit(WHITE_SPACE)), F.lit(""))


def has_text(text: Column) -> Column:
    return text.isNotNull().cast("int")
