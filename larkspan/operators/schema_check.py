"""JSON Schema checks of variant values, compiled to Column expressions: object, array, number, string, enum and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def violations(node: Column, schema: dict, at: str = "$", root: dict | None = None, present: Column | None = None) -> list[Column]:
    """Columns that say what is wrong with a variant value, each null where that is nothing; the paths are the schema's.

    Known keywords: $ref into $defs, type, required, properties,
    additionalProperties, items, minItems, maxItems, minimum, maximum, const
    and enum. The schema is a small document, so its walk makes an expression
    once; rows are checked natively. Items of an array share one path, with [].
    """
    root = root or schema
    if "$ref" in schema:
        name = schema["$ref"].removeprefix("#/$defs/")
        if name not in root.get("$defs", {}):
            raise ValueError(f"unresolved $ref {schema['$ref']} at {at}")
        return violations(node, root["$defs"][name], at, root, present)
    here = node.isNotNull() if present is None else present
    kind = F.split(F.schema_of_variant(node), "[<(]")[0]
    say = lambda bad, what: F.when(here & F.coalesce(bad, F.lit(True)), F.lit(f"{at}: {what}"))
    numbers, wanted = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), schema.get("type")
    number, string = F.try_variant_get(node, "$", "double"), F.try_variant_get(node, "$", "string")
    out = []
    if wanted == "object":
        keys = F.json_object_keys(F.to_json(node))
        is_object = kind == "OBJECT"
        out.append(say(~is_object, "not an object"))
        child = lambda k: F.try_variant_get(node, f"$['{k}']", "variant")
        has = lambda k: here & is_object & F.array_contains(keys, k)
        out += [F.when(here & is_object & ~F.array_contains(keys, k), F.lit(f"{at}: {k} is missing")) for k in schema.get("required", [])]
        if schema.get("additionalProperties") is False:
            more = F.array_except(keys, F.array(*(F.lit(k) for k in schema.get("properties", {}))).cast("array<string>"))
            out.append(F.when(here & is_object & (F.size(more) > 0), F.concat(F.lit(f"{at}: unexpected "), F.array_join(F.array_sort(more), ","))))
        for k, part in schema.get("properties", {}).items():
            out += violations(child(k), part, f"{at}.{k}", root, has(k))
        return out
    if wanted == "array":
        items = F.try_variant_get(node, "$", "array<variant>")
        out.append(say(kind != "ARRAY", "not an array"))
        n = F.size(items)
        if "minItems" in schema:
            out.append(F.when(here & (n < schema["minItems"]), F.lit(f"{at}: fewer than {schema['minItems']} items")))
        if "maxItems" in schema:
            out.append(F.when(here & (n > schema["maxItems"]), F.lit(f"{at}: more than {schema['maxItems']} items")))
        if "items" in schema:
            found = F.transform(items, lambda v: F.array_compact(F.array(F.lit(None).cast("string"), *violations(v, schema["items"], f"{at}[]", root, F.lit(True)))))
            out.append(F.when(here & (n > 0), F.nullif(F.array_join(F.array_distinct(F.flatten(found)), "; "), F.lit(""))))
        return out
    if wanted == "integer":
        out.append(say(~(kind.isin(*numbers) & (number == F.floor(number))), "not an integer"))
    elif wanted == "number":
        out.append(say(~kind.isin(*numbers), "not a number"))
    elif wanted == "string":
        out.append(say(kind != "STRING", "not a string"))
    elif wanted == "boolean":
        out.append(say(kind != "BOOLEAN", "not a boolean"))
    is_number = here & kind.isin(*numbers)
    if "minimum" in schema:
        out.append(F.when(is_number & (number < schema["minimum"]), F.lit(f"{at}: below {schema['minimum']}")))
    if "maximum" in schema:
        out.append(F.when(is_number & (number > schema["maximum"]), F.lit(f"{at}: above {schema['maximum']}")))
    allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if allowed is not None:
        fits = [(string == a) & (kind == "STRING") if isinstance(a, str) else (number == a) & kind.isin(*numbers) for a in allowed]
        one = F.lit(False)
        for f in fits:
            one = one | F.coalesce(f, F.lit(False))
        out.append(say(~one, "not an allowed value"))
    return out


def schema_faults(line: Column, schema: dict) -> Column:
    """array<string> of what is wrong with a JSON document; empty if it is valid."""
    value = F.try_parse_json(line)
    found = F.array_compact(F.array(F.lit(None).cast("string"), *violations(value, schema)))
    return F.when(value.isNull(), F.array(F.lit("$: not JSON"))).otherwise(found)
