"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is DataFrame functions, without a shuffle or a Python worker. A pattern's matches are
wrapped in a mark that the text does not hold, with a copy of the characters that follow; splitting
at the mark gives the piece before a match, the match and that copy in turn, and the running sum of
the lengths gives each match its place. Patterns use possessive repeats or bounded ones, and start
only at the head of a run or where the last match ended, so they cost as much as the text is long.
Matches are walked in stretches of about the square root of their number, as a list that grew by
one at a time would be copied for each: n matches cost n * sqrt(n) short steps at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, let

MARK = "\u0001"
CONTEXT = 48
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """pattern: what proposes a span; hint: what a text must match to be searched at all; confirm: a check of the matched text; score without context; words nearby that raise it.

    With ``fit`` the pattern only marks where a span may start: ``fit`` gives the span at the head of the ``reach`` characters from there, or an empty string.
    """

    name: str
    pattern: str
    hint: str
    score: float
    context: str
    confirm: object = None
    base: bool = True
    fit: object = None
    reach: int = 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _card(match: Column) -> Column:
    return let(_digits(match), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))


def _ip(match: Column) -> Column:
    return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


#: The countries of the IBAN registry by the length of their numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(plain: Column) -> Column:
    """Country and check digits moved to the end, letters read as 10 to 35: the number is 1 modulo 97."""
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    codes = F.transform(F.split(turned, ""), lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(codes, F.lit(0), lambda r, n: (r * F.when(n >= 10, 100).otherwise(10) + n) % 97) == 1


def _iban_at_head(text: Column) -> Column:
    """The IBAN that ``text`` starts with: of its country's length if there is one, else the longest that is 1 modulo 97."""

    def of_length(n):
        head = F.regexp_extract(text, f"^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])", 0)
        own = F.substr(text, F.lit(1), F.lit(2)).isin(IBAN_LENGTHS.get(n, "").split()) if n in IBAN_LENGTHS else F.lit(False)
        return F.struct(own.alias("own"), F.lit(n).alias("n"), head.alias("match"))

    valid = F.filter(F.array(*map(of_length, range(15, 35))), lambda c: (c["match"] != "") & let(F.regexp_replace(c["match"], " ", ""), _iban))
    return F.coalesce(F.array_max(valid)["match"], F.lit(""))


_SECRET = r"(?i)token|secret|passw|api[ _-]?key|private[ _-]?key|access[ _-]?key|bearer|credential"

#: The first four kinds are the base kinds, in the order in which ties are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]", 0.9, r"(?i)mail|contact|write|address"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"(?i)\bip\b|host|server|login|address", _ip),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]", 0.7, r"(?i)card|visa|credit|pay|account", _card),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"(?i)phone|call|tel|mobile|fax", _phone),
    Kind("iban", r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))", r"[A-Z]{2}[0-9]{2}", 0.8, r"(?i)iban|bank|account|konto", None, False, _iban_at_head, 66),
    Kind("key", r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{36,255}+|sk-[A-Za-z0-9_-]{20,200}+|xox[abprs]-[A-Za-z0-9-]{10,200}+)(?![A-Za-z0-9])", r"AKIA|gh[opsru]_|sk-|xox[abprs]-", 0.8, _SECRET, None, False),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,128}+(?![A-Za-z0-9])", r"[0-9a-f]{32}", 0.3, _SECRET, None, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", 0.3, r"(?i)ssn|social|security|tax", None, False),
)


def _by_stretches(items: Column, start: Column, walk, finish) -> Column:
    """``finish`` of the state that comes of ``start`` when ``walk(state, stretch)`` has gone over all stretches of ``items``, each of about the square root of their number."""

    def over(width):
        n = F.ceil(F.size(items) / width).cast("int")
        indices = F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
        return F.aggregate(indices, start, lambda state, k: walk(state, F.slice(items, k * width + 1, width)), finish)

    return let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int")), over)


def _walked(items: Column, state: Column, step, out_type: str) -> Column:
    """What ``step(state, item)`` gives as ``out`` for each item in turn; its ``state`` goes on to the next. Nulls are left out."""
    empty = F.expr(f"CAST(array() AS array<{out_type}>)")

    def one(held, item):
        return let(step(held["state"], item), lambda r: F.struct(r["state"].alias("state"), F.concat(held["out"], F.array(r["out"])).alias("out")))

    def walk(held, stretch):
        inner = F.aggregate(stretch, F.struct(held["state"].alias("state"), empty.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(held["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.expr(f"CAST(array() AS array<array<{out_type}>>)").alias("out"))
    return F.filter(_by_stretches(items, start, walk, lambda held: F.flatten(held["out"])), lambda x: x.isNotNull())


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of one kind in one text, in order; positions are code points from 0, ends exclusive."""

    found_type = "struct<start:int,end:int,match:string,before:string,rest:string>"

    def span(start, match, before, rest):
        return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"), before.alias("before"), rest.alias("rest"))

    def located(parts):
        """``parts`` come in threes: the text before a match, the match, and the characters from its end on."""

        def step(state, k):
            outside, match, rest = (F.get(parts, 3 * k + i) for i in range(3))
            begin = state["at"] + F.length(outside)
            before = F.right(F.concat(state["before"], outside), F.lit(CONTEXT))
            after = F.struct((begin + F.length(match)).alias("at"), F.right(F.concat(before, match), F.lit(CONTEXT)).alias("before"))
            return F.struct(after.alias("state"), span(begin, match, before, rest).alias("out"))

        n = F.floor(F.size(parts) / 3).cast("int")
        return _walked(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), F.struct(F.lit(0).alias("at"), F.lit("").alias("before")), step, found_type)

    def fitted(s):
        return let(kind.fit(s["rest"]), lambda m: span(s["start"], m, s["before"], F.substr(s["rest"], F.length(m) + 1)))

    def apart(spans):
        """``spans`` without those that start within an earlier one."""

        def step(last, s):
            free = s["start"] >= last
            return F.struct(F.when(free, s["end"]).otherwise(last).alias("state"), F.when(free, s).alias("out"))

        return _walked(spans, F.lit(0), step, found_type)

    marked = F.regexp_replace(text, f"({kind.pattern})(?=((?s:.{{0,{kind.reach + CONTEXT}}})))", f"{MARK}$1{MARK}$2{MARK}")
    found = let(F.split(marked, MARK, -1), located)
    if kind.fit is not None:
        found = let(F.filter(F.transform(found, fitted), lambda s: s["match"] != ""), apart)
    if kind.confirm is not None:
        found = F.filter(found, lambda s: kind.confirm(s["match"]))

    def scored(s):
        near = s["before"].rlike(kind.context) | F.substr(s["rest"], F.lit(1), F.lit(CONTEXT)).rlike(kind.context)
        score = F.lit(kind.score) + F.when(near, 1 - kind.score).otherwise(0.0) * 0.5
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), score.alias("score"))

    return F.when(text.rlike(kind.hint), F.transform(found, scored)).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def _rows_and_spans(docs: DataFrame, min_score: float) -> DataFrame:
    """(row, spans): the columns of ``docs`` as one struct, so that none of their names can clash, and the spans of ``text``."""
    clean = F.when(F.col("text").contains(MARK), F.translate("text", MARK, "\u0002")).otherwise(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), clean.alias("clean"))
    found = rows.select("row", *(_spans(F.col("clean"), k, i).alias(k.name) for i, k in enumerate(KINDS)))
    more = [F.filter(k.name, lambda s: s["score"] >= min_score) for k in KINDS if not k.base]
    return found.select("row", F.array_sort(F.concat(*(F.col(k.name) for k in KINDS if k.base), *more)).alias("spans"))


def find_pii(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` with a column ``pii``: its spans as (start, rank, kind, end, score), by start and then kind.

    Base kinds (email, ip, card, phone) stay whatever their score; spans of the other kinds stay
    from ``min_score`` on: iban (confirmed modulo 97), key (secrets of known forms), and secret
    (32 hexadecimal digits or more) and ssn, which need a context word. A word of the kind's
    context in the 48 characters before a span or after it moves its score halfway to 1, other
    spans in between or not.

    Null and empty texts have no spans; very long ones are searched whole. Every row gives one
    row, repeated rows and null doc_ids too; an empty table none. Spans of different kinds may
    overlap; those of one kind do not. Columns of any name pass through, but for one that is
    called ``pii`` already, whose place the spans take.
    """
    found = _rows_and_spans(docs, min_score)
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "pii"), F.col("spans").alias("pii"))


def mask_pii(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind, as in ``<EMAIL>``, and ``n_chars`` counted anew.

    Overlapping spans are replaced together, by the kind that starts first. Texts without spans,
    null and empty ones among them, stay as they are, and so do all other columns, whatever their
    names. Every row gives one row.
    """
    text = F.col("row").getField("text")

    def masked(spans):
        empty = F.expr("CAST(array() AS array<string>)")

        def walk(state, stretch):
            """The stretch's part of the text is cut out once, and its spans are looked up within that."""
            base = state["at"]
            reach = F.greatest(F.array_max(F.transform(stretch, lambda s: s["end"])) - base, F.lit(0))

            def within(part):
                def step(held, s):
                    between = F.substr(part, held["at"] - base + 1, s["start"] - held["at"])
                    new = F.struct(s["end"].alias("at"), F.concat(held["out"], F.array(between, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("out"))
                    longer = F.struct(F.greatest(held["at"], s["end"]).alias("at"), held["out"].alias("out"))
                    return F.when(s["start"] >= held["at"], new).otherwise(longer)

                return F.aggregate(stretch, F.struct(base.alias("at"), empty.alias("out")), step)

            inner = let(F.substr(text, base + 1, reach), within)
            return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(r["out"], ""))).alias("out")))

        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return _by_stretches(spans, start, walk, lambda state: F.concat(F.array_join(state["out"], ""), F.substr(text, state["at"] + 1)))

    found = _rows_and_spans(docs, min_score)
    found = found.select("row", "spans", F.when(F.size("spans") > 0, masked(F.col("spans"))).otherwise(text).alias("masked"))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("masked")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("spans") > 0, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def op7_pii_spans(spark, sf_dir):
    """Counts, places and scores of the personal data in every document: the base kinds' counts, ``n_other`` of the others, and each span's score in the order of ``spans``."""
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [k.name for k in KINDS if k.base]
    counts = {f"n_{k}": F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long") for k in base}
    more = {
        "base_sha256": F.sha2(listed(F.filter("pii", lambda s: s["kind"].isin(base))), 256),
        "spans": listed(F.col("pii")),
        "n_other": F.size(F.filter("pii", lambda s: ~s["kind"].isin(base))).cast("long"),
        "scores": F.array_join(F.transform("pii", lambda s: F.format_string("%.2f", s["score"])), ","),
    }
    return found.select("doc_id", *(c.alias(n) for n, c in (counts | more).items()))
