"""String expressions: name keys, paths, labels, URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: address prefix of the open photo archive.
PHOTO_PREFIX = "https://inaturalist-open-data.s3.amazonaws.com/photos/"
PHOTO_SIZE = "/medium."


def name_key(name: Column) -> Column:
    """Lower case, surrounding white space of any kind removed."""
    return F.regexp_replace(F.lower(name), r"(?U)^\s+|\s+$", "")


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def readable(slug_col: Column) -> Column:
    """Slug to name: blanks for underscores, first letter upper, the rest lower."""
    words = F.replace(slug_col, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2))))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def rank_path(names: list[Column]) -> Column:
    """Slash path of the names that are neither NULL nor empty."""
    return F.concat_ws("/", *[blank_to_null(n) for n in names])


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def photo_url(photo_id: Column, extension: Column) -> Column:
    return F.concat(F.lit(PHOTO_PREFIX), photo_id.cast("string"), F.lit(PHOTO_SIZE), extension)


def month_label(year: Column, month: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def label_to_date(label: Column) -> Column:
    """``YYYY`` or ``YYYY-MM`` to the first day of that span."""
    rest = F.when(F.length(label) == 4, F.lit("-01-01")).otherwise(F.lit("-01"))
    return F.to_date(F.concat(label, rest))


def matches_ignoring_case(text: Column, pattern: str) -> Column:
    """Regular-expression search; NULL never matches."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot, or '' where the file name has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def parent_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root``; the bare file name where it lies elsewhere."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(file_name(path))
