"""JSON Schemas (draft 07) compiled to expressions over variants: every breach of a payload, in the JVM.

A schema is walked once, on the driver; what comes of it is one column, so payloads are parsed once
and neither joined nor sent to Python. Keywords that the draft doesn't know are ignored.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import once

#: A breach: the JSON pointer of the value, the keyword that it breaks, and what to say of it.
BREACH = "array<struct<path: string, keyword: string, message: string, params: string>>"
# Formats by name; those of dates are parsed besides.
FORMATS = {
    "date-time": r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:?\d\d)$",
    "date": r"^\d{4}-\d\d-\d\d$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]\d\d:?\d\d)?$",
    "email": r"^[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "uuid": r"^(?i:(urn:uuid:)?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$",
}
_SIZES = (("minLength", "fewer", "characters"), ("maxLength", "more", "characters"), ("minItems", "fewer", "items"), ("maxItems", "more", "items"), ("minProperties", "fewer", "properties"), ("maxProperties", "more", "properties"))
_BOUNDS = {"minimum": ">=", "maximum": "<=", "exclusiveMinimum": ">", "exclusiveMaximum": "<"}


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _told(path: Column, keyword: str, message, params=None) -> Column:
    """One breach, as an array."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    params = params if isinstance(params, Column) else None if params is None else _json(params)
    return F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), as_column(message).alias("message"), as_column(params).cast("string").alias("params"))).cast(BREACH)


def _pointer(key: str) -> str:
    return "/" + key.replace("~", "~0").replace("/", "~1")


class Schema:
    """A schema document and its compilation; references stay within the document and must not come back to themselves."""

    def __init__(self, document: dict | bool):
        self.document = document

    def breaches(self, value: Column) -> Column:
        """All breaches of a variant, sorted by path, keyword and text; of a null, that it is not JSON."""
        found = F.array_sort(self._checked(self.document, value, F.lit(""), ()))
        return F.when(value.isNull(), _told(F.lit(""), "json", "must be JSON")).otherwise(found)

    def _target(self, pointer: str):
        if not pointer.startswith("#"):
            raise ValueError(f"a reference to another document: {pointer}")
        found = self.document
        for part in pointer[1:].split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            found = found[int(part)] if isinstance(found, list) else found[part]
        return found

    def _checked(self, schema, value: Column, path: Column, within: tuple) -> Column:
        """The breaches of ``value`` (a null is not there, and breaks nothing) as an array."""
        none = F.array().cast(BREACH)
        if schema is True or schema == {}:
            return none
        if schema is False:
            return F.when(value.isNotNull(), _told(path, "false schema", "boolean schema is false")).otherwise(none)
        if "$ref" in schema:
            if schema["$ref"] in within:
                raise ValueError(f"a schema within itself: {schema['$ref']}")
            return self._checked(self._target(schema["$ref"]), value, path, (*within, schema["$ref"]))
        held = F.struct(value.alias("v"), F.try_variant_get(value, "$", "map<string,variant>").alias("o"), F.try_variant_get(value, "$", "array<variant>").alias("a"))

        def facts(h):
            scalar = F.when(h["o"].isNull() & h["a"].isNull(), h["v"])
            shape, number = F.schema_of_variant(scalar), F.try_variant_get(scalar, "$", "double")
            told = F.when(h["o"].isNotNull(), "object").when(h["a"].isNotNull(), "array").when(h["v"].isNull(), None)
            told = told.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise(F.when(number == F.floor(number), "integer").otherwise("number"))
            return F.struct(h["v"].alias("v"), h["o"].alias("o"), h["a"].alias("a"), told.alias("kind"))

        def judged(f):
            checks = [c for part in (self._general, self._scalar, self._object, self._array, self._combined) for c in part(schema, f, path, within)]
            return F.flatten(F.filter(F.array(*checks), lambda c: c.isNotNull())).cast(BREACH) if checks else none

        return F.when(value.isNotNull(), once(held, lambda h: once(facts(h), judged))).otherwise(none)

    def _general(self, schema, f, path, within):
        kind = f["kind"]
        if "type" in schema:
            wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            good = kind.isin(*wanted, *(["integer"] if "number" in wanted else []))
            yield F.when(~good, _told(path, "type", f"must be {','.join(wanted)}", {"type": schema["type"]}))
        if "const" in schema:
            yield F.when(~self._equal(f, schema["const"]), _told(path, "const", "must be equal to constant", {"allowedValue": schema["const"]}))
        if "enum" in schema:
            same = functools.reduce(lambda a, b: a | b, (self._equal(f, x) for x in schema["enum"]), F.lit(False))
            yield F.when(~same, _told(path, "enum", "must be equal to one of the allowed values", {"allowedValues": schema["enum"]}))

    @staticmethod
    def _equal(f, given) -> Column:
        """Whether a value equals a given one: numbers by their value, others by their form, with keys in one order."""
        if isinstance(given, (int, float)) and not isinstance(given, bool):
            return F.coalesce(f["kind"].isin("integer", "number") & (F.try_variant_get(f["v"], "$", "double") == float(given)), F.lit(False))
        return F.to_json(f["v"]) == F.to_json(F.parse_json(F.lit(_json(given))))

    def _scalar(self, schema, f, path, within):
        text = F.when(f["kind"] == "string", F.try_variant_get(f["v"], "$", "string"))
        number = F.when(f["kind"].isin("integer", "number"), F.try_variant_get(f["v"], "$", "double"))
        if "pattern" in schema:
            yield F.when(~text.rlike(schema["pattern"]), _told(path, "pattern", f"must match pattern \"{schema['pattern']}\"", {"pattern": schema["pattern"]}))
        if schema.get("format") in FORMATS:
            name = schema["format"]
            good = text.rlike(FORMATS[name])
            if name.startswith("date"):
                good &= (F.try_to_timestamp(text) if name == "date-time" else F.try_to_date(text, "yyyy-MM-dd")).isNotNull()
            yield F.when(text.isNotNull() & ~good, _told(path, "format", f'must match format "{name}"', {"format": name}))
        for keyword, comparison in _BOUNDS.items():
            if keyword in schema:
                limit = schema[keyword]
                good = {">=": number >= limit, "<=": number <= limit, ">": number > limit, "<": number < limit}[comparison]
                yield F.when(~good, _told(path, keyword, f"must be {comparison} {_json(limit)}", {"comparison": comparison, "limit": limit}))
        if "multipleOf" in schema:
            share = number / schema["multipleOf"]
            yield F.when(share != F.floor(share), _told(path, "multipleOf", f"must be multiple of {_json(schema['multipleOf'])}", {"multipleOf": schema["multipleOf"]}))
        sizes = {"characters": F.length(text), "items": F.size(f["a"]), "properties": F.size(F.map_keys(f["o"]))}
        there = {"characters": text.isNotNull(), "items": f["a"].isNotNull(), "properties": f["o"].isNotNull()}
        for keyword, word, what in _SIZES:
            if keyword in schema:
                wrong = sizes[what] < schema[keyword] if word == "fewer" else sizes[what] > schema[keyword]
                yield F.when(there[what] & wrong, _told(path, keyword, f"must NOT have {word} than {schema[keyword]} {what}", {"limit": schema[keyword]}))

    def _object(self, schema, f, path, within):
        held, keys = f["o"], F.map_keys(f["o"])
        for key in schema.get("required", ()):
            yield F.when(held.isNotNull() & ~F.map_contains_key(held, F.lit(key)), _told(path, "required", f"must have required property '{key}'", {"missingProperty": key}))
        known, patterns = list(schema.get("properties", {})), schema.get("patternProperties", {})
        for key, inner in schema.get("properties", {}).items():
            yield F.when(held.isNotNull(), self._checked(inner, F.try_element_at(held, F.lit(key)), F.concat(path, F.lit(_pointer(key))), within))
        below = lambda key: F.concat(path, F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        each = lambda wanted, inner: F.when(held.isNotNull(), F.flatten(F.transform(F.filter(F.map_entries(held), lambda e: wanted(e["key"])), lambda e: self._checked(inner, e["value"], below(e["key"]), within))))
        for pattern, inner in patterns.items():
            yield each(functools.partial(lambda pattern, key: key.rlike(pattern), pattern), inner)
        more = schema.get("additionalProperties", True)
        other = lambda key: functools.reduce(lambda a, b: a & ~key.rlike(b), patterns, ~key.isin(*known) if known else F.lit(True))
        if more is False:
            yield F.when(held.isNotNull(), F.flatten(F.transform(F.filter(keys, other), lambda key: _told(path, "additionalProperties", "must NOT have additional properties", F.to_json(F.struct(key.alias("additionalProperty")))))))
        elif more is not True:
            yield each(other, more)
        if "propertyNames" in schema:
            inner = schema["propertyNames"]
            name = lambda key: F.try_variant_get(F.parse_json(F.to_json(F.array(key))), "$[0]", "variant")
            named = lambda key: F.size(self._checked(inner, name(key), path, within)) > 0
            yield F.when(held.isNotNull(), F.flatten(F.transform(F.filter(keys, named), lambda key: _told(path, "propertyNames", "property name must be valid", F.to_json(F.struct(key.alias("propertyName")))))))

    def _array(self, schema, f, path, within):
        held, items = f["a"], schema.get("items", True)
        below = lambda i: F.concat(path, F.lit("/"), i.cast("string"))
        if isinstance(items, list):
            for k, inner in enumerate(items):
                yield F.when(held.isNotNull(), self._checked(inner, F.get(held, F.lit(k)), F.concat(path, F.lit(f"/{k}")), within))
            rest = schema.get("additionalItems", True)
            if rest is not True:
                after = F.filter(F.transform(held, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] >= len(items))
                yield F.when(held.isNotNull(), F.flatten(F.transform(after, lambda s: self._checked(rest, s["x"], below(s["i"]), within))))
        elif items is not True:
            yield F.when(held.isNotNull(), F.flatten(F.transform(held, lambda x, i: self._checked(items, x, below(i), within))))
        if schema.get("uniqueItems"):
            texts = F.transform(held, lambda x: F.to_json(x))
            yield F.when(F.size(F.array_distinct(texts)) < F.size(texts), _told(path, "uniqueItems", "must NOT have duplicate items"))
        if "contains" in schema:
            fits = F.exists(held, lambda x: F.size(self._checked(schema["contains"], x, path, within)) == 0)
            yield F.when(held.isNotNull() & ~fits, _told(path, "contains", "must contain at least 1 valid item(s)", {"minContains": 1}))

    def _combined(self, schema, f, path, within):
        of = lambda inner: self._checked(inner, f["v"], path, within)
        valid = lambda inner: F.size(of(inner)) == 0
        for inner in schema.get("allOf", ()):
            yield of(inner)
        if "anyOf" in schema:
            fits = functools.reduce(lambda a, b: a | b, map(valid, schema["anyOf"]))
            yield F.when(~fits, _told(path, "anyOf", "must match a schema in anyOf"))
        if "oneOf" in schema:
            fits = functools.reduce(lambda a, b: a + b, (valid(inner).cast("int") for inner in schema["oneOf"]))
            yield F.when(fits != 1, _told(path, "oneOf", "must match exactly one schema in oneOf"))
        if "not" in schema:
            yield F.when(valid(schema["not"]), _told(path, "not", "must NOT be valid"))
        if "if" in schema:
            for branch, holds in (("then", valid(schema["if"])), ("else", ~valid(schema["if"]))):
                if branch in schema:
                    yield F.when(holds, of(schema[branch]))


@functools.lru_cache(256)
def compiled(text: str) -> Schema:
    """The schema in a JSON text, parsed once."""
    return Schema(json.loads(text))


_named: dict[tuple[str, str], Schema] = {}


def named(spark: SparkSession, folder: str, name: str) -> Schema:
    """The schema in ``folder``/``name``.schema.json, wherever Spark reads, once for each name."""
    if (folder, name) not in _named:
        rows = spark.read.option("wholetext", True).text(f"{folder.rstrip('/')}/{name}.schema.json").head(1)
        if not rows:
            raise ValueError(f"no schema {name}")
        _named[folder, name] = compiled(rows[0][0])
    return _named[folder, name]


def checked(payloads: DataFrame, schema: Schema | dict, payload: str = "payload") -> DataFrame:
    """``payloads`` with ``breaches`` (BREACH): all that their JSON text breaks in the schema, none of a conforming one."""
    schema = schema if isinstance(schema, Schema) else Schema(schema)
    parsed = payloads.withColumn("_variant", F.try_parse_json(F.col(payload)))
    return parsed.withColumn("breaches", schema.breaches(F.col("_variant"))).drop("_variant")


def detail(breaches: Column | str) -> Column:
    """Breaches as lines of text; an empty text of none."""
    line = lambda b: F.concat(F.lit("  - "), F.when(b["path"] == "", "(root)").otherwise(b["path"]), F.lit(" "), b["message"], F.coalesce(F.concat(F.lit(" "), b["params"]), F.lit("")))
    return F.array_join(F.transform(breaches, line), "\n")


def checked_answers(answers: DataFrame, schema: Schema | dict, expected: int | None = None) -> DataFrame:
    """``answers`` (url, status, body) with ``breaches`` and ``ok``: the expected status, or any of 2xx, and a body that conforms."""
    status = F.col("status").between(200, 299) if expected is None else F.col("status") == expected
    return checked(answers, schema, "body").withColumn("ok", F.coalesce(status, F.lit(False)) & (F.size("breaches") == 0))
