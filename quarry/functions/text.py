"""Text and id functions as column expressions, which Spark compiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything but letters and digits separates words.
SEPARATORS = r"[^\p{L}\p{N}]+"


def words(text: Column | str) -> Column:
    """Lower-cased words of a text, in order."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def clip(text: Column | str, size: int) -> Column:
    """At most `size` characters, with an ellipsis where more were cut."""
    kept = F.trim(text)
    return F.when(F.length(kept) > size, F.concat(F.rtrim(F.substring(kept, 1, size)), F.lit("…"))).otherwise(kept)


def name_key(name: Column | str) -> Column:
    """A name for comparison: lower case, one space for each run of other signs than letters, digits and plus."""
    return F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("ё"), F.lit("е")), r"[^a-zа-я0-9+]+", " "))


def stable_id(prefix: str, *parts: Column | str, size: int = 16) -> Column:
    """prefix and the first hexadecimal digits of SHA-1 over the parts, joined by colons; null reads None."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("None")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws(":", *texts).cast("binary")), 1, size))


def relation_type(name: Column | str) -> Column:
    """A relation's type: upper case, other signs as underscores, 64 characters at most, RELATED_TO by default."""
    cleaned = F.substring(F.regexp_replace(F.upper(F.trim(name)), r"[^A-Z0-9_]", "_"), 1, 64)
    return F.coalesce(F.when(cleaned != "", cleaned), F.lit("RELATED_TO"))


def year_of(*candidates: Column | str) -> Column:
    """The first year from 1900 to 2099 that candidates hold, in their order: a number by itself or inside a text."""
    found = [F.try_to_number(F.nullif(F.regexp_extract((F.col(c) if isinstance(c, str) else c).cast("string"), r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("")), F.lit("9999")).cast("int") for c in candidates]
    return F.coalesce(*found)


# fixed values: where a record's year may stand, in this order: fields of its own, then fields of nested records
YEAR_FIELDS = ("year", "publication_year", "document_year", "source_year")
YEAR_RECORDS = ("document_metadata", "extra_metadata", "metadata")
NESTED_YEAR_FIELDS = ("year", "publication_year", "document_year", "date", "publication_date", "created", "creation_date", "modified", "modification_date", "CreationDate", "ModDate")


def record_year(record: Column | str, filename: Column | str | None = None) -> Column:
    """The year of a record without a schema (a variant): of its own fields, else of nested records, else of a file's name.

    A number counts as it stands, truncated; a text by the first year that stands apart from other digits; only 1900 to
    2100 are years.  Without a name given, the record's own filename counts.  Null where nothing has a year.
    """
    variant = F.col(record) if isinstance(record, str) else record
    paths = [f"$.{f}" for f in YEAR_FIELDS] + [f"$.{r}.{f}" for r in YEAR_RECORDS for f in NESTED_YEAR_FIELDS]

    def year_at(path: str) -> Column:
        text, kind = F.try_variant_get(variant, path, "string"), F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
        number = F.try_variant_get(variant, path, "double")
        of_number = F.when(number >= 1900, F.when(number < 2101, F.floor(number).cast("int")))
        is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
        return F.when(is_number, of_number).when(kind != "BOOLEAN", _year_in(text))

    name = F.try_variant_get(variant, "$.filename", "string") if filename is None else (F.col(filename) if isinstance(filename, str) else filename)
    return F.coalesce(*map(year_at, paths), _year_in(name))


def _year_in(text: Column) -> Column:
    return F.regexp_extract(text, r"(?<![0-9])(19[0-9]{2}|20[0-9]{2}|2100)(?![0-9])", 1).try_cast("int")


def range_text(low: Column | str, value: Column | str, high: Column | str) -> Column:
    """A value or range for reading: 1–2, 1, ≤2, ≥1 or nothing; whole numbers without a fraction."""
    show = lambda c: F.regexp_replace((F.col(c) if isinstance(c, str) else c).cast("string"), r"\.0$", "")
    low, value, high = (F.col(c) if isinstance(c, str) else c for c in (low, value, high))
    both = low.isNotNull() & high.isNotNull()
    return F.when(both, F.concat(show(low), F.lit("–"), show(high))).when(value.isNotNull(), show(value)).when(high.isNotNull(), F.concat(F.lit("≤"), show(high))).when(low.isNotNull(), F.concat(F.lit("≥"), show(low))).otherwise("")
