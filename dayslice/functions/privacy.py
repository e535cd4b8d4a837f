"""Column masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col

# Mask patterns. Ten digits keep the outer six; an address keeps two letters.
PHONE_PATTERN = r"(\d{3})\d{4}(\d{3})"
PHONE_REPLACEMENT = "$1****$2"
EMAIL_PATTERN = r"(^[^@]{2})[^@]+(@.+)"
EMAIL_REPLACEMENT = "$1***$2"


def mask_phone(c: Column | str) -> Column:
    """0901234567 becomes 090****567; other shapes pass unchanged; NULL stays NULL."""
    return F.regexp_replace(as_col(c), PHONE_PATTERN, PHONE_REPLACEMENT)


def mask_email(c: Column | str) -> Column:
    """john@x.com becomes jo***@x.com."""
    return F.regexp_replace(as_col(c), EMAIL_PATTERN, EMAIL_REPLACEMENT)


def hash_text(c: Column | str) -> Column:
    """One-way SHA-256 of the text, as hex."""
    return F.sha2(as_col(c).cast("string"), 256)


def null_of(dtype: str) -> Column:
    """NULL of the column's own type, so that the schema does not change."""
    return F.lit(None).cast(dtype)


# Masks that a policy may name. Each takes the column and its type.
MASKS: dict[str, Callable[[Column, str], Column]] = {
    "phone": lambda c, _type: mask_phone(c),
    "email": lambda c, _type: mask_email(c),
    "hash": lambda c, _type: hash_text(c),
    "null": lambda _c, dtype: null_of(dtype),
}
