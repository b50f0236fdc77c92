"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "~~"


def external_path(object_path: Column, attr_name: Column) -> Column:
    """``object[attribute]``; NULL when a part is NULL."""
    return F.concat(object_path, F.lit("["), attr_name, F.lit("]"))


def external_path_or_blank(object_path: Column, attr_name: Column) -> Column:
    """``object[attribute]`` with a NULL part written as nothing."""
    return external_path(F.coalesce(object_path, F.lit("")), F.coalesce(attr_name, F.lit("")))


def relative_change(new: Column, old: Column) -> Column:
    """(new - old) / old, NULL when old is zero."""
    return (new - old) / F.nullif(old, F.lit(0.0))


def type_flags(code: Column) -> dict[str, Column]:
    """Attribute flags from a type code such as ``CLAK``, by position."""
    return {
        "is_cost": F.substring(code, 1, 1) == "C",
        "is_lever": F.substring(code, 2, 1) == "L",
        "is_calculated": F.substring(code, 2, 1) == "C",
        "is_aggregate": F.substring(code, 3, 1) == "A",
        "is_kpi": F.substring(code, 4, 1) == "K",
    }


def path_levels(path: Column, max_name_len: int | None = None) -> Column:
    """The names along a delimited category path, root first; one trailing delimiter is ignored."""
    parts = F.split(path, SEPARATOR)
    kept = F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)
    return kept if max_name_len is None else F.transform(kept, lambda name: F.substring(name, 1, max_name_len))


def is_usable_path(path: Column) -> Column:
    """False for NULL and empty paths and for an odd run of ``~`` at the end."""
    return path.isNotNull() & (path != "") & (F.length(F.regexp_extract(path, "(~*)$", 1)) % 2 == 0)
