"""Keys that are equal apart from surrounding white space and letter case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: Unicode white space
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def eq_key(c: Column) -> Column:
    """Trimmed, lower-case form of a key; null stays null, a blank becomes ''."""
    return F.lower(F.btrim(c, F.lit(SPACE)))


def ref_key(c: Column) -> Column:
    """``eq_key``, with null for a blank: null and blank are no reference."""
    k = eq_key(c)
    return F.when(k != "", k)


def known_key(c: Column, *none: str) -> Column:
    """``ref_key``, with null for the given words as well."""
    k = eq_key(c)
    return F.when(~k.isin("", *none), k)


def sql_key(expr: str) -> str:
    """DuckDB form of ``eq_key``."""
    chars = " || ".join(f"chr({ord(x)})" for x in SPACE)
    return f"lower(trim({expr}, {chars}))"
