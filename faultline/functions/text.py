"""Name normalisation for headers (driver side) and for column values (Spark side)."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import SOURCE_NAMES


def _ascii(text: str) -> str:
    return unicodedata.normalize("NFD", text).encode("ascii", "ignore").decode("ascii")


def header_name(text: str | None) -> str:
    """Plain lower-case ASCII words joined by ``_``; every other character is dropped."""
    if text is None:
        return ""
    words = re.sub(r"[^a-z0-9\s]", "", _ascii(str(text)).lower().strip())
    return re.sub(r"\s+", "_", words)


def _accent_table() -> tuple[str, str]:
    """All characters whose canonical decomposition holds one ASCII character (none holds more)."""
    pairs = []
    for code in range(0xA0, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code))
        if parts and not parts.startswith("<"):
            plain = _ascii(chr(code))
            if len(plain) == 1:
                pairs.append((chr(code), plain))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, UNACCENTED = _accent_table()


def normalized_text(col: Column | str) -> Column:
    """:func:`header_name` for a string column; null becomes the empty string."""
    col = F.col(col) if isinstance(col, str) else col
    plain = F.regexp_replace(F.translate(col, ACCENTED, UNACCENTED), r"[^\x00-\x7F]", "")
    plain = F.regexp_replace(F.lower(plain), r"^\s+|\s+$", "")
    words = F.regexp_replace(plain, r"[^a-z0-9\s]", "")
    return F.coalesce(F.regexp_replace(words, r"\s+", "_"), F.lit(""))


def normalized_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[header_name(c) for c in df.columns])


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename the columns that are present; the first of two sources of a name wins."""
    taken: set[str] = set(df.columns) - set(mapping)
    picks = []
    for c in df.columns:
        target = mapping.get(c, c)
        if target != c and target in taken:
            target = c
        taken.add(target)
        picks.append(F.col(f"`{c}`").alias(target))
    return df.select(*picks)


def to_source_names(df: DataFrame) -> DataFrame:
    """Column names as in the source documents (``asset_id`` -> ``ativo_unico`` ...)."""
    names = dict(SOURCE_NAMES)
    for c in df.columns:
        rolling = re.fullmatch(r"tbf_(mean|std|min|max)_(\d+)", c)
        target = re.fullmatch(r"fails_within_(\d+)d", c)
        if rolling:
            names[c] = f"tbf_{rolling[1]}_{rolling[2]}eventos"
        elif target:
            names[c] = f"falha_em_{target[1]}d"
    return renamed(df, names)


def trimmed(name: str) -> Column:
    """Strip white space of any kind from both ends."""
    return F.regexp_replace(F.col(name).cast("string"), r"^\s+|\s+$", "")


def fixed(x: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded from the exact binary value (ties to even).

    The product with the power of ten is taken with its rounding error (split
    multiplication), so 0.075 gives 0.07 and 0.125 gives 0.12.
    """
    scale = float(10**digits)
    split = x * F.lit(134217729.0)
    high = split - (split - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("double")
    rest = (product - whole - 0.5) + error
    up = (rest > 0) | ((rest == 0) & (whole % 2 != 0))
    rounded = F.when(F.abs(product) < 2.0**52, F.when(up, whole + 1).otherwise(whole)).otherwise(product)
    return F.format_string(f"%.{digits}f", rounded / scale)
