"""A strict codec of nested tagged values over VARIANT: a closed registry, walked level by level with exact keys at each.

An entity is {"schema": 3, "type": tag, "value": {fields}}; a field is a plain kind ("string", "bigint", "decimal(18,6)", "boolean"), the tag
of an entity of the registry, or a list of one of these. Decoding parses a text once and tells the first issue in the order of the walk; nothing
that the registry does not name passes. A column used in many places would be worked out in each, so what is read of a text is bound once (_once).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the version that texts carry.
SCHEMA = 3
Kind = str | list
Registry = dict[str, dict[str, Kind]]
#: What schema_of_variant calls a value of a plain kind.
_SHAPES = {"string": ("STRING",), "bigint": ("BIGINT",), "boolean": ("BOOLEAN",), "decimal": ("BIGINT", "DECIMAL", "DOUBLE")}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first(*issues: Column) -> Column:
    return F.coalesce(*issues) if issues else F.lit(None).cast("string")


def _plain(v: Column, kind: str, path: str) -> Column:
    # up to the type's parameters
    shape = F.substring_index(F.schema_of_variant(v), "(", 1)
    fine = F.is_variant_null(v) | shape.isin(*_SHAPES[kind.split("(")[0]])
    return F.when(~F.coalesce(fine, F.lit(False)), F.lit(f"wrong_kind:{path}"))


def _value(v: Column, kind: Kind, registry: Registry, path: str) -> Column:
    if isinstance(kind, list):
        is_list = F.coalesce(F.schema_of_variant(v).startswith("ARRAY<"), F.lit(False))
        items = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _value(x, kind[0], registry, f"{path}[]")), lambda i: i.isNotNull())
        return F.when(~is_list, F.lit(f"wrong_kind:{path}")).otherwise(F.try_element_at(items, F.lit(1)))
    if kind in registry:
        return issue_of(v, kind, registry, path)
    return _once(v, lambda x: _plain(x, kind, path))


def issue_of(v: Column, tag: str, registry: Registry, path: str = "$") -> Column:
    """The first issue of a variant that should be an entity of tag, null if there is none."""
    fields = registry[tag]
    wrong = lambda c: ~F.coalesce(c, F.lit(False))
    named = F.array(*[F.lit(x) for x in ("schema", "type", "value")])
    own = F.array(*[F.lit(x) for x in sorted(fields)]).cast("array<string>")

    def told(outer: Column) -> Column:
        at = lambda name: F.try_element_at(outer, F.lit(name))
        type_ = F.try_variant_get(at("type"), "$", "string")
        head = (
            F.when(wrong(F.array_sort(F.map_keys(outer)) == named), F.lit(f"not_an_entity:{path}"))
            .when(wrong(F.try_variant_get(at("schema"), "$", "int") == SCHEMA), F.lit(f"unsupported_schema:{path}"))
            .when(wrong(type_.isin(*registry)), F.lit(f"unknown_type:{path}"))
            .when(wrong(type_ == tag), F.lit(f"unexpected_type:{path}"))
        )
        return _first(head, _once(F.try_variant_get(at("value"), "$", "map<string,variant>"), inside))

    def inside(inner: Column) -> Column:
        keys = F.when(wrong(F.array_sort(F.map_keys(inner)) == own), F.lit(f"unexpected_keys:{path}"))
        return _first(keys, *(_value(F.try_element_at(inner, F.lit(f)), kind, registry, f"{path}.{f}") for f, kind in fields.items()))

    return _once(F.try_variant_get(v, "$", "map<string,variant>"), told)


def _read(v: Column, kind: Kind, registry: Registry) -> Column:
    if isinstance(kind, list):
        return F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _read(x, kind[0], registry))
    if kind in registry:
        own = lambda value: F.struct(*[_read(F.try_variant_get(value, f"$.{f}", "variant"), k, registry).alias(f) for f, k in registry[kind].items()])
        return _once(F.try_variant_get(v, "$.value", "variant"), own)
    return F.try_variant_get(v, "$", kind)


def decoded(text: Column, tag: str, registry: Registry) -> Column:
    """struct(value, issue) of a text: its fields as nested structs, only where nothing is wrong at any level."""
    malformed = lambda v: F.when(v.isNull() | F.is_variant_null(v), F.lit("malformed"))
    both = lambda v: _once(malformed(v).otherwise(issue_of(v, tag, registry)), lambda i: F.struct(F.when(i.isNull(), _read(v, tag, registry)).alias("value"), i.alias("issue")))
    return _once(F.try_parse_json(text), both)


def encoded(value: Column, tag: str, registry: Registry) -> Column:
    """The text of a nested struct: fields in sorted order at each level, no spaces."""
    return F.to_json(_tagged(value, tag, registry), {"ignoreNullFields": "false"})


def _tagged(value: Column, kind: Kind, registry: Registry) -> Column:
    if isinstance(kind, list):
        return F.transform(value, lambda x: _tagged(x, kind[0], registry))
    if kind in registry:
        body = F.struct(*[_tagged(value[f], registry[kind][f], registry).alias(f) for f in sorted(registry[kind])])
        return F.struct(F.lit(SCHEMA).alias("schema"), F.lit(kind).alias("type"), body.alias("value"))
    return value
