"""Text and array expressions that filters share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

NO_STRINGS = "array<string>"


def strings(values: Column) -> Column:
    """A missing list is an empty one."""
    return F.coalesce(values, F.array().cast(NO_STRINGS))


def contains_all(values: Column, required: list[str]) -> Column:
    """All of ``required`` are among the values; nothing required is always true."""
    return F.size(F.array_except(F.array(*[F.lit(r) for r in required]).cast(NO_STRINGS), strings(values))) == 0


def normalized(value: Column) -> Column:
    """Lower case, ``_`` as ``-``, white space collapsed."""
    return F.regexp_replace(F.trim(F.translate(F.lower(value), "_", "-")), r"\s+", " ")


def any_contains(needle: str, *values: Column) -> Column:
    """The normalised needle is part of any of the values."""
    wanted = normalized(F.lit(needle))
    return F.exists(F.array(*values), lambda v: F.coalesce(F.contains(normalized(v), wanted), F.lit(False)))


def search_key(value: Column) -> Column:
    """Lower case with anything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(value), r"(?U)[\W_]+", " "))


def flat(value: Column, kind: DataType) -> Column:
    """All values of a nested column as one text (names of fields and keys are left out)."""
    if isinstance(kind, StructType):
        return F.concat_ws(" ", *[flat(value[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, MapType):
        return flat(F.map_values(value), ArrayType(kind.valueType))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.array_join(F.transform(value, lambda x: F.coalesce(flat(x, kind.elementType), F.lit(""))), " "), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def each_flat(values: Column, kind: ArrayType) -> Column:
    """One text for each element of an array (a missing array has none)."""
    return strings(F.transform(values, lambda x: flat(x, kind.elementType)))


def matches_terms(values: Column, terms: list[str]) -> Column:
    """Each term is part of some value."""
    wanted = F.transform(F.array(*[F.lit(t) for t in terms]).cast(NO_STRINGS), search_key)
    return F.forall(wanted, lambda t: F.exists(strings(values), lambda v: F.contains(search_key(v), t)))


def split_pipe(value: Column, keep_unknown: bool = True) -> Column:
    """Values between ``|``; blank ones go, and ``unknown`` in any case unless kept."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") if keep_unknown else ((x != "") & (F.lower(x) != "unknown")))


def subject_pattern(pattern: Column) -> Column:
    """Regular expression of a broker subject filter: ``*`` is one token, ``>`` at the end is one or more."""
    tokens = F.transform(F.split(pattern, r"\."), lambda t: F.when(t == "*", r"[^.]+").when(t == ">", r".+").otherwise(F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))))
    return F.concat(F.lit("^"), F.array_join(tokens, r"\."), F.lit("$"))


def subject_matches(pattern: Column, subject: Column) -> Column:
    return F.call_function("rlike", subject, subject_pattern(pattern))
