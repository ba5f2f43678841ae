"""Normal forms of ids and category names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_key(c: Column | str) -> Column:
    """Trim all white space at both ends and lower the case; null stays null, blank becomes ''."""
    return F.lower(F.btrim(_col(c), F.lit(WHITE_SPACE)))


def norm_category(c: Column | str) -> Column:
    """norm_key with blanks and hyphens as underscores; null and blank give null."""
    key = F.translate(norm_key(c), " -", "__")
    return F.when(key != "", key)


def hash_hex(salt: str, *keys: Column) -> Column:
    """First 16 hex digits of SHA-256 of salt and keys joined by ':'; text order is the order of the 64 unsigned bits."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), *keys), 256), 1, 16)
