"""Scalar functions over disclosure text, names, dates and amounts, as Column expressions.

Parsers give null for what they do not recognise; the caller routes such rows, instead of the
query failing. White space is Unicode white space throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transaction codes and words, with (type, partial).
TX_TYPES = {
    "p": ("buy", False),
    "purchase": ("buy", False),
    "s": ("sell", False),
    "sale": ("sell", False),
    "sale (full)": ("sell", False),
    "s (full)": ("sell", False),
    "s (partial)": ("sell", True),
    "sale (partial)": ("sell", True),
    "e": ("exchange", False),
    "exchange": ("exchange", False),
}
# Asset codes.
ASSET_CODES = {
    "ST": "Stock",
    "OP": "Option",
    "EF": "ETF",
    "MF": "Mutual Fund",
    "GS": "Government Security",
    "CS": "Corporate Security",
    "CT": "Cryptocurrency",
    "OT": "Other",
}
# Owner words (an empty value stands for the filer).
OWNERS = {"self": "", "spouse": "SP", "joint": "JT", "child": "DC", "dependent child": "DC"}
# Words before and after a name that are not part of it.
HONORIFICS = "hon\\.?|mr\\.?|mrs\\.?|ms\\.?|dr\\.?|senator|sen\\.?|rep\\.?|representative"
SUFFIXES = "jr\\.?|sr\\.?|ii|iii|iv|v|md|m\\.d\\."


# Unicode white space, as trim takes it and within a class of a pattern.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The same but the blank itself as a pattern's ranges, of which there are fewer to try at each letter.
BLANK_RANGES = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def as_column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def once(value, body) -> Column:
    """``body(value)``, with ``value`` evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x) -> Column:
    """Without white space at either end."""
    return F.btrim(as_column(x), F.lit(BLANKS))


def collapse(x) -> Column:
    """Stripped, with every run of white space as one blank."""
    return strip(F.regexp_replace(as_column(x), f"[ {BLANK_RANGES}]{{2,}}|[{BLANK_RANGES}]", " "))  # single blanks stay


def untidy(x) -> Column:
    """Whether collapse() may change a string: of ASCII letters without blanks that it would change, no; a pattern costs far more."""
    text = as_column(x)
    seen = (F.length(text) != F.octet_length(text)) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for blank in ("  ", *BLANKS[:5]):
        seen = seen | F.contains(text, F.lit(blank))
    return seen


def blank_to_null(x) -> Column:
    return F.nullif(as_column(x), F.lit(""))


def snippet(x, length: int = 500) -> Column:
    """The first ``length`` characters with collapsed white space."""
    return F.left(collapse(x), F.lit(length))


def parse_amount(label) -> Column:
    """(lo, hi, label) of a disclosed bracket: two amounts, one with 'less', or one with 'over', 'more' or '+'; else null."""
    dollars = lambda n: F.concat(F.lit("$"), F.format_number(n, 0))
    row = lambda a, b, text: F.struct(a.alias("lo"), b.alias("hi"), text.alias("label"))
    none = F.lit(None).cast("long")

    def parsed(clean):
        lowered = F.lower(clean)

        def bracket(found):
            lo, hi = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(2))
            one = F.when(lowered.contains("less"), row(F.lit(0).cast("long"), lo, F.concat(dollars(lo), F.lit(" or less"))))
            one = one.when(lowered.contains("over") | clean.contains("+") | lowered.contains("more"), row(lo, none, F.concat(dollars(lo), F.lit(" +"))))
            return F.when(F.exists(found, lambda n: n.isNull()), None).when(F.size(found) == 2, row(lo, hi, F.concat(dollars(lo), F.lit(" - "), dollars(hi)))).when(F.size(found) == 1, one)

        amounts = F.regexp_extract_all(clean, F.lit(r"\$\s*([0-9,]+)"), 1)
        return once(F.transform(amounts, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long")), bracket)

    return once(collapse(F.regexp_replace(as_column(label), "[‐-―−]", "-")), parsed)


def parse_tx_type(raw) -> Column:
    """(type, partial) of a transaction word or code; null if unknown."""
    key = collapse(F.regexp_replace(F.lower(strip(raw)), r"\.+$", ""))
    kinds = F.create_map(*(x for k, (t, p) in TX_TYPES.items() for x in (F.lit(k), F.struct(F.lit(t).alias("type"), F.lit(p).alias("partial")))))
    return F.try_element_at(kinds, key)


def parse_date(raw) -> Column:
    """Month/day/year or ISO, with or without leading zeros; else null."""
    clean = strip(raw)
    us = F.when(clean.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(clean, "M/d/yyyy"))
    iso = F.when(clean.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(clean, "yyyy-M-d"))
    return F.coalesce(us, iso)


def us_date(day) -> Column:
    return F.date_format(as_column(day), "MM/dd/yyyy")


def prune_cutoff(day) -> Column:
    """January 1 of the year before."""
    return F.make_date(F.year(as_column(day)) - 1, F.lit(1), F.lit(1))


def canonical_name(raw) -> Column:
    """Lower-case key of a name: honorifics and suffixes gone, 'Last, First' turned, blanks collapsed."""
    clean = F.regexp_replace(strip(raw), r"(?iU),?\s+(jr|sr|ii|iii|iv|v)\.?\s*$", "")
    comma = F.locate(",", clean)
    turned = F.when(comma > 0, F.concat(strip(F.substr(clean, comma + 1)), F.lit(" "), strip(F.left(clean, comma - 1)))).otherwise(clean)
    plain = F.lower(collapse(turned))
    headless = F.regexp_replace(plain, f"^(?:(?:{HONORIFICS})(?: |$))+", "")
    return strip(F.regexp_replace(headless, f"(?:(?:^| )(?:{SUFFIXES}))+$", ""))


def first_last_key(name) -> Column:
    """First and last word of a canonical name of more than two words; else the name."""
    words = F.split(as_column(name), " ")
    return F.when(F.size(words) > 2, F.concat_ws(" ", F.element_at(words, 1), F.element_at(words, -1))).otherwise(as_column(name))


def without_initial(name) -> Column:
    """A canonical name without a leading initial, if it has more than two words and one; else null."""
    words = F.split(as_column(name), " ")
    return F.when((F.size(words) > 2) & F.element_at(words, 1).rlike(r"^[a-z]\.?$"), F.array_join(F.slice(words, 2, F.size(words)), " "))


def owner_code(raw) -> Column:
    """SP, JT or DC for the known words, null for the filer or nothing, other words as they are."""
    clean = strip(raw)
    return blank_to_null(F.coalesce(F.try_element_at(literal_map(OWNERS), F.lower(clean)), clean))


def clean_ticker(raw) -> Column:
    """Without blanks and dashes at the ends; null if nothing is left."""
    return blank_to_null(strip(F.regexp_replace(strip(raw), "^-+|-+$", "")))


def state_district(raw) -> Column:
    """(state, district) of 'TX10'; a leading zero goes, and 00 is 0; null if it has another form."""
    clean = strip(raw)
    state = F.left(clean, F.lit(2))
    return F.when(clean.rlike("^[A-Z]{2}[0-9]{2}$"), F.struct(state.alias("state"), F.concat_ws("-", state, F.right(clean, F.lit(2)).try_cast("int").cast("string")).alias("district")))


def listed_ticker(asset) -> Column:
    """The first '(ABC)' of an asset text."""
    return blank_to_null(F.regexp_extract(as_column(asset), r"\(([A-Z][A-Z0-9.\-]{0,9})\)", 1))


def listed_asset_type(asset) -> Column:
    """The first '[XX]' of an asset text, in words where the code is known."""
    code = blank_to_null(F.regexp_extract(as_column(asset), r"\[([A-Z]{2})\]", 1))
    return F.coalesce(F.try_element_at(literal_map(ASSET_CODES), code), code)


def plain_asset(asset) -> Column:
    """An asset text without its tickers, codes and a trailing filing-status mark."""
    bare = F.regexp_replace(F.regexp_replace(as_column(asset), r"\([A-Z][A-Z0-9.\-]{0,9}\)", ""), r"\[[A-Z]{2}\]", "")
    return F.regexp_replace(collapse(F.regexp_replace(bare, r"(?U)\bF\s+S\s*$", "")), "^[ -]+|[ -]+$", "")


def absolute_url(href, base: str) -> Column:
    return F.when(F.startswith(as_column(href), F.lit("http")), as_column(href)).otherwise(F.concat(F.lit(base), as_column(href)))


def last_segment(url) -> Column:
    return F.element_at(F.split(F.regexp_replace(as_column(url), "/+$", ""), "/"), -1)


def market_symbol(ticker) -> Column:
    """Upper case, with runs of other than letters and digits as one dash between."""
    return F.regexp_replace(F.regexp_replace(F.upper(strip(ticker)), "[^A-Z0-9]+", "-"), "^-+|-+$", "")


def notional_mid(lo="amount_lo", hi="amount_hi") -> Column:
    """The middle of a bracket; the floor of the open one."""
    lo, hi = as_column(lo), as_column(hi)
    return F.when(hi.isNotNull(), (lo + hi) / 2).otherwise(lo.cast("double"))


def half_up(x, digits: int = 0) -> Column:
    """Rounded to the nearest, ties towards plus infinity."""
    return F.floor(as_column(x) * 10**digits + 0.5) / 10**digits


def money_text(x) -> Column:
    """'$12M' from ten million, '$1.2M' from a million, '$12k' from a thousand, else '$12'."""
    x = as_column(x)
    whole = lambda v: half_up(v).cast("long").cast("string")
    return (
        F.when(x >= 1e7, F.concat(F.lit("$"), whole(x / 1e6), F.lit("M")))
        .when(x >= 1e6, F.concat(F.lit("$"), F.format_string("%.1f", x / 1e6), F.lit("M")))
        .when(x >= 1e3, F.concat(F.lit("$"), whole(x / 1e3), F.lit("k")))
        .otherwise(F.concat(F.lit("$"), whole(x)))
    )


def company_name(asset) -> Column:
    """An asset name without a trailing price fragment and share-class words."""
    bare = F.regexp_replace(as_column(asset), r"(?U)\s*\$\S*\??\s*$", "")
    bare = F.regexp_replace(bare, r"(?iU)[-\s]*(new\s+)?(class\s+[a-z]\s+)?(common stock|ordinary shares|common shares)\s*$", "")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), r"[-\s]+$", ""))


def buy_share(buys, sells) -> Column:
    """Buys in per cent of buys and sells, to the nearest; 0 if there are neither."""
    return half_up(100 * as_column(buys) / F.greatest(as_column(buys) + as_column(sells), F.lit(1))).cast("long")


def percent_text(p, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", as_column(p) * 100)


def exact_round(x, digits: int) -> Column:
    """Rounded as the exact binary value, ties to even, as Python's round(); round() takes a double's shortest decimal form instead.

    The value is scaled by a power of ten as a product and its rounding error (Dekker's product
    of split factors), so it is known on which side of a half it lies.
    """
    scale = float(10**digits)
    split = lambda v: v * 134_217_729.0 - (v * 134_217_729.0 - v)  # noqa: E731 - the upper half of the bits
    upper = scale * 134_217_729.0 - (scale * 134_217_729.0 - scale)

    def rounded(v):
        def with_product(product):
            high = split(v)
            error = high * upper - product + high * (scale - upper) + (v - high) * upper + (v - high) * (scale - upper)

            def at(whole):
                past = (product - whole - 0.5) + error
                return (whole + F.when((past > 0) | ((past == 0) & (whole % 2 == 1)), 1.0).otherwise(0.0)) / scale

            return once(F.floor(product).cast("double"), at)

        return F.when(F.isnan(v) | (v * scale >= 2.0**52), v).otherwise(once(v * scale, with_product))

    x = as_column(x).cast("double")
    return once(x, lambda v: F.when(v < 0, -rounded(-v)).otherwise(rounded(v)))


def html_escape(x) -> Column:
    """With & < > and both quotes as character references; null as an empty text."""
    out = F.coalesce(as_column(x), F.lit(""))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def poisson_pmf(k, mean) -> Column:
    """The Poisson probability of ``k``; all of it at 0 for a mean of 0 or less."""
    k, mean = as_column(k), as_column(mean)
    factors = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.expr("CAST(array() AS array<int>)"))
    pmf = F.aggregate(factors, F.exp(-mean), lambda p, i: p * mean / i)
    return F.when(mean <= 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(pmf)


def low_score_factor(i, j, home, away, rho) -> Column:
    """The dependency of low scores in the two-Poisson model."""
    i, j, home, away, rho = map(as_column, (i, j, home, away, rho))
    return (
        F.when((i == 0) & (j == 0), 1 - home * away * rho)
        .when((i == 0) & (j == 1), 1 + home * rho)
        .when((i == 1) & (j == 0), 1 + away * rho)
        .when((i == 1) & (j == 1), 1 - rho)
        .otherwise(1.0)
    )
