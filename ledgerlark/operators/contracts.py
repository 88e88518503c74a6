"""Strict payload contracts, page health and reachability, as rules joined with payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import once

# The unauthenticated answer of the token-refresh endpoint.
_STRINGS = ("environ", "error", "eventDescription", "ip", "logLevelName", "node", "pod", "request")
_INTEGERS = ("application", "endpoint", "event", "logLevel")
_CONSTANTS = {"applicationName": "login", "endpointName": "refresh", "eventCode": "unauthorized", "eventName": "Unauthorized"}
LOGIN_REFRESH = [
    ("$", "event", "object", None, True),
    *(("$.event", k, "string", None, True) for k in _STRINGS),
    *(("$.event", k, "integer", None, True) for k in _INTEGERS),
    *(("$.event", k, "string", v, True) for k, v in _CONSTANTS.items()),
    ("$.event", "when", "date-time", None, True),
]


def environment(known: dict[str, str], name: str | None = None, usual: str = "dev") -> str:
    """What is ``known`` of the environment ``name``, or of the ``usual`` one; an unknown name is an error that lists the valid ones."""
    name = name or usual
    if name not in known:
        raise ValueError(f"unknown environment {name}; valid ones: {', '.join(known)}")
    return known[name]


def _prefixed(words: str):
    return lambda k: F.concat(F.lit(words), k)


def violations(payloads: DataFrame, rules: list[tuple], payload: str = "payload") -> DataFrame:
    """``payloads`` with ``violations``: every breach of the rules, sorted; empty if the payload conforms.

    Rules are few and fixed, so they are unrolled into one expression and nothing is joined. Each
    payload is parsed once; its objects are maps of values from then on.
    """
    paths = list(dict.fromkeys(path for path, *_ in rules))
    at = {path: f"_contract_{k}" for k, path in enumerate(paths)}
    root = F.try_parse_json(F.col(payload))
    parsed = payloads.withColumn("_contract", root)
    parsed = parsed.withColumns({c: F.try_variant_get("_contract", path, "map<string,variant>") for path, c in at.items()})
    found = []
    for path in paths:
        own = [r for r in rules if r[0] == path]
        held = F.col(at[path])
        extra = F.array_except(F.map_keys(held), F.array(*(F.lit(k) for _, k, *_ in own)))
        found.append(F.transform(extra, _prefixed(f"{path}: extra ")))
        found += [_breach(held, f"{path}.{key}", key, kind, const, required) for _, key, kind, const, required in own]
    none = F.expr("CAST(array() AS array<string>)")
    every = F.flatten(F.array(*(F.coalesce(f, none) for f in found)))
    invalid = F.try_variant_get("_contract", "$", "map<string,variant>").isNull()
    out = F.when(invalid, F.array(F.lit("$: not an object"))).otherwise(F.array_sort(every))
    return parsed.withColumn("violations", out).drop("_contract", *at.values())


def _breach(held: Column, name: str, key: str, kind: str, const: str | None, required: bool) -> Column:
    """The breach of one rule as an array of one text; null if there is none."""
    told = lambda what: F.array(F.lit(f"{name}: {what}"))

    def judged(value):
        plain, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")

        def of_shape(shape):
            good = {
                "string": shape == "STRING",
                "integer": (shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL")) & (number == F.floor(number)),
                "object": shape.startswith("OBJECT"),
                "date-time": (shape == "STRING") & plain.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(plain).isNotNull(),
            }[kind]
            wrong = F.when(~F.coalesce(good, F.lit(False)), told(f"not a {kind}"))
            return wrong if const is None else wrong.when(plain != const, told(f"not {const}"))

        return once(F.schema_of_variant(value), of_shape)

    missing = F.when(held.isNotNull() & ~F.map_contains_key(held, F.lit(key)), told("missing")) if required else F.lit(None).cast("array<string>")
    return F.coalesce(missing, F.when(F.map_contains_key(held, F.lit(key)), once(F.try_element_at(held, F.lit(key)), judged)))


def health_gate(pages: DataFrame) -> DataFrame:
    """One row: how many pages of page_health() are healthy and how many aren't, and whether all are."""
    counts = pages.agg(F.count_if("healthy").alias("healthy"), F.count_if(~F.col("healthy")).alias("unhealthy"))
    return counts.withColumn("all_pass", F.col("unhealthy") == 0)


def unexpected_failures(responses: DataFrame, expected: str) -> DataFrame:
    """Responses with a status of 400 or more whose url doesn't match ``expected``."""
    return responses.filter((F.col("status") >= 400) & ~F.col("url").rlike(expected))


def browser_problems(log: DataFrame, expected: str, event: str = "event") -> DataFrame:
    """(page, what, text) of the problems in a log of browser events (page, and ``event``, a JSON object with its kind): uncaught errors, and requests that failed or were answered with 400 or more, but for addresses that match ``expected``.

    ``what`` is error or failure, as page_health() takes them. Events that aren't JSON, and other
    kinds, are no problem. The log may be a stream.
    """
    e = F.from_json(event, "kind string, message string, method string, url string, status int, error string")
    rows = log.select("page", e.alias("e"))
    told = lambda *parts: F.concat_ws(" ", *(F.coalesce(F.col(f"e.{p}").cast("string"), F.lit("")) for p in parts))
    unexpected = ~F.coalesce(F.col("e.url").rlike(expected), F.lit(False))
    text = F.when(F.col("e.kind") == "pageerror", F.concat(F.lit("Uncaught: "), told("message")))
    text = text.when(unexpected & (F.col("e.kind") == "requestfailed"), F.concat(told("method", "url"), F.lit(" — "), F.coalesce("e.error", F.lit("failed"))))
    text = text.when(unexpected & (F.col("e.kind") == "response") & (F.col("e.status") >= 400), told("status", "method", "url"))
    return rows.select("page", F.when(F.col("e.kind") == "pageerror", "error").otherwise("failure").alias("what"), text.alias("text")).filter("text IS NOT NULL")


def page_health(pages: DataFrame, errors: DataFrame, failures: DataFrame) -> DataFrame:
    """For each page its errors, unexpected failures and whether it is healthy: without either."""
    n = lambda df, name: df.groupBy("page").agg(F.count("*").alias(name))
    out = pages.join(n(errors, "errors"), "page", "left").join(n(failures, "failures"), "page", "left").fillna(0, ["errors", "failures"])
    return out.withColumn("healthy", (F.col("errors") == 0) & (F.col("failures") == 0))


def rollout(probes: DataFrame, rules: dict[str, bool]) -> DataFrame:
    """By environment: probes seen, whether some are expected, and whether that holds; an unknown environment is an error."""
    expected = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))
    seen = probes.groupBy("env").agg(F.sum(F.col("seen").cast("long")).alias("n"))
    want = F.try_element_at(expected, F.col("env"))
    return seen.withColumn("expected", F.coalesce(want, F.raise_error(F.concat(F.lit("unknown environment "), F.col("env"))).cast("boolean"))).withColumn("holds", (F.col("n") > 0) == F.col("expected"))


def reachability(probes: DataFrame) -> DataFrame:
    """Each probe's outcome: blocked by a deny header, unreachable, or its status."""
    ok = F.col("error").isNull() & F.col("deny").isNull()
    return probes.withColumn("outcome", F.when(F.col("deny").isNotNull(), "blocked").when(F.col("error").isNotNull(), "unreachable").otherwise("reachable")).withColumn("ok", ok)
