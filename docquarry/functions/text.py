"""Scalar text functions as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folding of accented Latin letters to ASCII.
ACCENTED = "àáâãäåèéêëìíîïòóôõöøùúûüýÿçñšžÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝÇÑŠŽ"
PLAIN = "aaaaaaeeeeiiiioooooouuuuyycnszAAAAAAEEEEIIIIOOOOOOUUUUYCNSZ"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space around (newlines too, unlike trim)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def word_count(x: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")).cast("long")


def tokens(x: Column | str, fold: bool = False, stem: bool = False) -> Column:
    """Analyzer: lower case, split at non-letters and non-digits; optionally stems, without accents."""
    text = F.lower(_c(x))
    if fold:
        text = F.replace(F.translate(text, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if stem:
        from .stemmer import stemmed

        words = stemmed(words)
    return words


def file_key(path: Column | str) -> Column:
    """Base name without extension, lower case, anything but letters, digits, _ and - as _."""
    base = F.regexp_replace(F.regexp_replace(_c(path), r"^.*/", ""), r"\.[^.]*$", "")
    return F.regexp_replace(F.lower(base), r"[^\p{L}\p{N}_-]", "_")


def dataset_name(name: Column | str) -> Column:
    """One rule for table names: lower case, blanks and dashes as _, never a leading _, - or +."""
    plain = F.regexp_replace(F.lower(_c(name)), r"[\s-]", "_")
    return F.when(plain.rlike(r"^[_+-]"), F.concat(F.lit("idx_"), plain)).otherwise(plain)


def letters(x: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(x), r"[^\p{L}]", "")).cast("long")


def specials(x: Column | str) -> Column:
    """Characters that are neither letters, digits nor white space."""
    return F.length(F.regexp_replace(_c(x), r"[\p{L}\p{N}\s]", "")).cast("long")


def preview(x: Column | str, n: int = 150) -> Column:
    """The first n characters and, always, three dots."""
    return F.concat(F.substring(_c(x), 1, n), F.lit("..."))
