"""Values by dotted path from JSON whose layout differs from row to row.

A text is parsed once into a variant; a path such as ``vendor.name`` is looked up
key by key. What is missing, null, or stands where an object is expected is null,
and the next path is tried. Nothing is inferred or collected: a layout never seen
before costs a longer list of paths, not another pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_path(dotted: str) -> str:
    """``a.b`` as a variant path; a key may hold any characters but dots and both kinds of quotes."""
    keys = dotted.split(".")
    if not all(keys) or any("'" in key and '"' in key for key in keys):
        raise ValueError(f"no path: {dotted!r}")
    return "$" + "".join(f'["{key}"]' if "'" in key else f"['{key}']" for key in keys)


def at_path(value: Column, dotted: str, kind: str = "string") -> Column:
    """The value at one path of a variant, null if it is no scalar or not of that kind."""
    found = F.try_variant_get(value, variant_path(dotted), kind)
    if kind != "string":
        return found
    shape = F.schema_of_variant(F.try_variant_get(value, variant_path(dotted), "variant"))
    return F.when(~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"), found)


def first_at(value: Column, paths: list[str], kind: str = "string") -> Column:
    """The first path that holds a value; an empty text is none."""
    found = [at_path(value, p, kind) for p in paths]
    return F.coalesce(*([F.nullif(c, F.lit("")) for c in found] if kind == "string" else found))


def fields(json: Column | str, wanted: dict[str, tuple[list[str], str]]) -> list[Column]:
    """A column for each wanted (paths, kind); texts that are no JSON give nulls."""
    value = F.try_parse_json(json)
    return [first_at(value, paths, kind).alias(name) for name, (paths, kind) in wanted.items()]
