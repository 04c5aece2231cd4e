"""JSON Schemas compiled to VARIANT expressions: the first error of a JSON text as one column, without Python workers.

Each subschema becomes an expression that is null where the value fits and else ``path: what is wrong``. A value is bound
once, as the variable of a one-element ``transform``, so the size of the expression is that of the schema, and arrays and
objects of any length are walked inside the row. Errors come in the order of :func:`json_schema.errors`: fields by name,
items by place. Schemas that refer to themselves, and Python-only patterns, are refused with :class:`Unsupported`.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, functions as F

NOT_JSON = "$: not JSON"
_NULL = "cast(null as string)"


class Unsupported(Exception):
    """A schema that has no finite expression."""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID, BIGINT, DECIMAL or DOUBLE."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _is(name: str, v: Column, kind: Column) -> Column:
    numbers = ("BIGINT", "DECIMAL", "DOUBLE")
    whole = (kind == "BIGINT") | ((kind == "DECIMAL") & ~F.contains(F.to_json(v), F.lit("."))) | ((kind == "DOUBLE") & (F.floor(_double(v)).cast("double") == _double(v)) & (F.abs(_double(v)) < 1e300))
    plain = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
    return kind == plain[name] if name in plain else kind.isin(*numbers) if name == "number" else F.coalesce(whole, F.lit(False))


def canonical(v: Column) -> Column:
    """Equal texts for equal values: fields by name, numbers by value (within arrays and objects, if written without exponent)."""
    whole = F.floor(_double(v)) == _double(v)
    plain = F.when((_kind(v) == "DOUBLE") & whole & (F.abs(_double(v)) < 1e15), _double(v).cast("long").cast("string"))
    return F.coalesce(plain, F.to_json(v))


def _constant(value: object) -> Column:
    return canonical(F.parse_json(F.lit(json.dumps(value))))


def _number_outside(v: Column, schema: dict) -> Column:
    exact = F.try_variant_get(v, "$", "decimal(38,18)")
    out = F.lit(False)
    for name, beyond in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b)):
        if name in schema:
            limit = schema[name]
            sharp = beyond(exact, F.lit(str(limit)).cast("decimal(38,18)")) if abs(limit) < 1e18 else F.lit(None).cast("boolean")
            out = out | F.coalesce(sharp, beyond(_double(v), F.lit(float(limit))))
    return out


def _pattern(pattern: str) -> str:
    if "(?P" in pattern or "\\Z" in pattern or "\\N" in pattern:
        raise Unsupported(pattern)
    return f"(?U){pattern}"


def _first(errors: list[Column]) -> Column:
    return F.coalesce(*errors) if errors else F.expr(_NULL)


class _Compiler:
    def __init__(self, root: dict):
        self.root = root

    def check(self, v: Column, schema: dict | bool, at: Column, within: tuple[str, ...] = ()) -> Column:
        """``v`` and ``at`` are cheap: variables or literals."""
        says = lambda what: F.concat(at, F.lit(f": {what}"))
        if isinstance(schema, bool):
            return F.expr(_NULL) if schema else says("not allowed")
        go = lambda s: self.check(v, s, at, within)
        fits = lambda s: go(s).isNull()
        first: list[Column] = []
        if "$ref" in schema:
            if schema["$ref"] in within:
                raise Unsupported(schema["$ref"])
            target: object = self.root
            for part in schema["$ref"].removeprefix("#/").split("/"):
                target = target[part]  # type: ignore[index]
            first.append(self.check(v, target, at, (*within, schema["$ref"])))  # type: ignore[arg-type]

        def rest(kind: Column) -> Column:
            errors: list[Column] = []
            if "const" in schema:
                errors.append(F.when(canonical(v) != _constant(schema["const"]), says(f"not {json.dumps(schema['const'], sort_keys=True, ensure_ascii=False)}")))
            if "enum" in schema:
                errors.append(F.when(~canonical(v).isin(*map(_constant, schema["enum"])), says("not one of the allowed values")))
            if "anyOf" in schema:
                any_ = F.lit(False)
                for s in schema["anyOf"]:
                    any_ = any_ | fits(s)
                errors.append(F.when(~any_, says("fits no alternative")))
            errors += map(go, schema.get("allOf", ()))
            if "not" in schema:
                errors.append(F.when(fits(schema["not"]), says("fits what it must not")))
            if "if" in schema and ("then" in schema or "else" in schema):
                errors.append(F.when(fits(schema["if"]), go(schema.get("then", True))).otherwise(go(schema.get("else", True))))
            for name, rule in (("STRING", self.text), ("ARRAY", self.items), ("OBJECT", self.fields)):
                found = rule(v, schema, at, says, within)
                if found is not None:
                    errors.append(F.when(kind == name, found))
            if schema.keys() & {"minimum", "maximum", "exclusiveMinimum"}:
                errors.append(F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE") & _number_outside(v, schema), says("out of range")))
            return _first(errors)

        def typed(kind: Column) -> Column:
            wanted = schema.get("type")
            if wanted is None:
                return rest(kind)
            names = [wanted] if isinstance(wanted, str) else wanted
            hit = F.lit(False)
            for n in names:
                hit = hit | _is(n, v, kind)
            return F.when(~hit, says(f"not {' or '.join(names)}")).otherwise(rest(kind))

        first.append(_let(_kind(v), typed))
        return _first(first)

    def text(self, v: Column, schema: dict, at: Column, says: Callable, within: tuple) -> Column | None:
        if not schema.keys() & {"minLength", "maxLength", "pattern"}:
            return None

        def rules(s: Column) -> Column:
            errors = []
            if "minLength" in schema:
                errors.append(F.when(F.length(s) < schema["minLength"], says("too short")))
            if "maxLength" in schema:
                errors.append(F.when(F.length(s) > schema["maxLength"], says("too long")))
            if "pattern" in schema:
                errors.append(F.when(~F.rlike(s, F.lit(_pattern(schema["pattern"]))), says("does not match")))
            return _first(errors)

        return _let(F.try_variant_get(v, "$", "string"), rules)

    def items(self, v: Column, schema: dict, at: Column, says: Callable, within: tuple) -> Column | None:
        if not schema.keys() & {"minItems", "maxItems", "uniqueItems", "items"}:
            return None

        def rules(a: Column) -> Column:
            errors = []
            if "minItems" in schema:
                errors.append(F.when(F.size(a) < schema["minItems"], says("too few items")))
            if "maxItems" in schema:
                errors.append(F.when(F.size(a) > schema["maxItems"], says("too many items")))
            if schema.get("uniqueItems"):
                errors.append(F.when(F.size(F.array_distinct(F.transform(a, canonical))) < F.size(a), says("repeated items")))
            if "items" in schema:
                found = F.transform(a, lambda x, i: _let(F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), lambda p: self.check(x, schema["items"], p, within)))
                errors.append(F.get(F.filter(found, lambda e: e.isNotNull()), F.lit(0)))
            return _first(errors)

        return _let(F.try_variant_get(v, "$", "array<variant>"), rules)

    def fields(self, v: Column, schema: dict, at: Column, says: Callable, within: tuple) -> Column | None:
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        if not schema.get("required") and not known and more is True:
            return None

        def rules(m: Column) -> Column:
            errors = [F.when(~F.map_contains_key(m, name), says(f"lacks {name}")) for name in schema.get("required", ())]

            def found(name: Column, wanted: dict | bool) -> Column:
                step = _let(F.struct(F.element_at(m, name).alias("v"), F.concat(at, F.lit("."), name).alias("p")), lambda x: self.check(x["v"], wanted, x["p"], within))
                return F.struct(name.alias("name"), step.alias("e"))

            none = F.expr("cast(null as struct<name: string, e: string>)")
            listed = [F.when(F.map_contains_key(m, n), found(F.lit(n), s)).otherwise(none) for n, s in known.items() if s is not True]
            wrong = F.array(*listed) if listed else F.expr("cast(array() as array<struct<name: string, e: string>>)")
            if more is not True:
                names = F.filter(F.map_keys(m), lambda k: ~k.isin(*known)) if known else F.map_keys(m)
                unknown = lambda k: F.struct(k.alias("name"), F.concat(at, F.lit(": unknown field "), k).alias("e"))
                wrong = F.concat(wrong, F.transform(names, unknown if more is False else lambda k: found(k, more)))
            errors.append(F.array_min(F.filter(wrong, lambda w: w["e"].isNotNull()))["e"])
            return _first(errors)

        return _let(F.try_variant_get(v, "$", "map<string,variant>"), rules)


def first_error(text: Column, schema: dict) -> Column:
    """The first error of a JSON text, or null. Null and anything that is no single JSON value, repeats a field's name or nests
    more than 999 levels deep is ``$: not JSON``."""
    # the parser ignores what follows a value, so it has to close two different brackets
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    keyed = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}"))), "$", "map<string,variant>")
    value = F.when((F.size(listed) == 1) & (F.size(keyed) == 1), F.get(listed, F.lit(0)))
    return _let(value, lambda v: F.when(v.isNull(), NOT_JSON).otherwise(_Compiler(schema).check(v, schema, F.lit("$"))))
