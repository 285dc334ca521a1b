"""Text helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["normalize_text", "word_count", "desc_prefix", "safe_key", "is_valid_email",
           "EMAIL_PATTERN", "WS"]

# Whitespace set used for stripping and splitting: space, tab, newline, CR, VT, FF.
WS = r"[ \t\n\r\x0B\f]"

# Fixed value: accepted e-mail shape (local@domain.tld).
EMAIL_PATTERN = r"^[A-Za-z0-9._%+#-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"


WS_CHARS = " \t\n\r\x0b\f"


def normalize_text(x: Column) -> Column:
    """Lower-case and strip leading/trailing whitespace (``trim`` strips spaces only,
    ``btrim`` with the whitespace set strips all of them)."""
    return F.lower(F.btrim(x, F.lit(WS_CHARS)))


def word_count(x: Column) -> Column:
    """Number of whitespace-separated tokens (0 for the empty string)."""
    return F.size(F.filter(F.split(x, f"{WS}+"), lambda t: t != ""))


def desc_prefix(x: Column, n: int = 10) -> Column:
    """first ``n`` characters, null read as ''."""
    return F.substring(F.coalesce(x, F.lit("")), 1, n)


def safe_key(x: Column) -> Column:
    """trim, replace every char other than letter/digit/-/_ by '_', strip '_', '' -> 'category'."""
    s = F.regexp_replace(F.trim(x), r"[^\p{L}\p{N}_-]", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("category"))


def is_valid_email(x: Column) -> Column:
    return F.coalesce(x.rlike(EMAIL_PATTERN), F.lit(False))
