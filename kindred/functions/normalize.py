"""Field normalization as Catalyst expressions.

Null and empty both mean "no value": every function returns '' for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DateType, StringType, TimestampNTZType, TimestampType

# White space of Unicode, at the ends of a value.
_ENDS = "^[\\s\\u0085\\p{Z}]+|[\\s\\u0085\\p{Z}]+$"

# Gender codes and the words that stand for them.
GENDERS = {
    "m": ["m", "male", "man", "boy"],
    "f": ["f", "female", "woman", "girl"],
    "nb": ["nb", "nonbinary", "non-binary", "non binary", "enby"],
    "o": ["o", "other"],
    "u": ["u", "unknown", "unspecified", "prefer not to say"],
}

# Accepted date forms in order: what a value must look like, and how it is read.
DATES = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{2}-\d{2}-\d{4}$", "MM-dd-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
]
SHORT_DATE = r"^\d{1,2}/\d{1,2}/\d{2}$"
#: Two-digit years from here on belong to the twentieth century.
PIVOT = 69


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(text(c), _ENDS, "")


def basic(c: Column, kind: DataType | None = None) -> Column:
    """Trim and lower case; dates and timestamps as yyyy-MM-dd; bytes as they are."""
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    if isinstance(kind, BinaryType):
        return text(c)
    return F.lower(trimmed(c))


def name(c: Column) -> Column:
    """Lower case letters and single spaces; everything else is deleted."""
    letters = F.regexp_replace(F.lower(trimmed(c)), "[^a-z\\t\\n\\f\\r ]", "")
    return F.trim(F.regexp_replace(letters, "[\\t\\n\\f\\r ]+", " "))


def date(c: Column) -> Column:
    """The first accepted form as yyyy-MM-dd, month first; else trimmed lower case."""
    value = text(c)
    read = [F.when(value.rlike(shape), F.try_to_date(value, form)) for shape, form in DATES]
    month, day, year = (F.regexp_extract(value, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", i) for i in (1, 2, 3))
    full = F.when(year.try_cast("int") >= PIVOT, F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    read.append(F.when(value.rlike(SHORT_DATE), F.try_to_date(F.concat_ws("/", month, day, full), "M/d/yyyy")))
    return F.coalesce(F.date_format(F.coalesce(*read), "yyyy-MM-dd"), F.lower(trimmed(c)))


def gender(c: Column) -> Column:
    value = F.lower(trimmed(c))
    out = F.when(text(c) == "", F.lit(""))
    for code, words in GENDERS.items():
        out = out.when(value.isin(words), F.lit(code))
    first = F.substring(value, 1, 1)
    return out.when(first.isin("m", "f", "o", "u"), first).otherwise(F.lit("u"))


def zip_code(c: Column) -> Column:
    return F.substring(F.regexp_replace(text(c), "[^0-9]", ""), 1, 5)


def bloom_text(c: Column) -> Column:
    """What goes into a Bloom filter: lower case letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def packed(c: Column) -> Column:
    """Lower case without spaces."""
    return F.lower(F.replace(text(c), F.lit(" "), F.lit("")))


def token_text(c: Column, column: str, kind: DataType | None = None) -> Column:
    """What goes into a keyed token: basic form; a column named zip drops its spaces too."""
    value = basic(c, kind)
    return F.replace(value, F.lit(" "), F.lit("")) if column == "zip" and (kind is None or isinstance(kind, StringType)) else value


METHODS = {"name": name, "date": date, "gender": gender, "zip": zip_code}


def parse_field(spec: str) -> tuple[str, str | None]:
    """'method:column' or 'column' to (column, method); an unknown method is dropped, the column kept."""
    parts = spec.split(":")
    if len(parts) == 2:
        method, column = parts[0].strip().lower(), parts[1].strip()
        return column, method if method in METHODS else None
    return spec.strip(), None


def parse_config(specs: list[str]) -> dict[str, str]:
    """column -> method of the specs that name a known method; others are dropped."""
    return {c: m for c, m in map(parse_field, specs) if m}


def normalized(c: Column, method: str | None, kind: DataType | None = None) -> Column:
    return METHODS[method](c) if method else basic(c, kind)
