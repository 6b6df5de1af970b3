"""Parsing, money, fees, keys and text as column expressions: nothing here leaves the JVM."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Minor units to the major one, symbols, and names of currencies.
MINOR_UNITS = {"INR": 100, "USD": 100, "EUR": 100, "GBP": 100, "AED": 100, "SGD": 100, "AUD": 100, "CAD": 100, "JPY": 1, "KWD": 1000, "BHD": 1000}
SYMBOLS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£", "AED": "AED ", "SGD": "S$", "AUD": "A$", "CAD": "C$", "JPY": "¥"}
ALIASES = {"RS": "INR", "RS.": "INR", "INR.": "INR", "₹": "INR", "$": "USD", "US$": "USD", "USD$": "USD"}
BLANKS = ["", "-", "nan", "None"]
NO_DATE = "1970-01-01"
DISPUTE_NAMES = {
    "open": "open", "created": "open", "initiated": "open", "under_review": "under_review", "disputed": "under_review", "contested": "under_review",
    "won": "won", "reversed": "won", "lost": "lost", "chargeback": "lost", "debited": "lost", "accepted": "accepted", "closed": "accepted",
}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def parse_date(c: Column) -> Column:
    """FN1 on text: five layouts, then the first ten characters as ISO; NO_DATE where none fits."""
    s = F.trim(c.cast("string"))
    tries = [F.try_to_date(s, f) for f in ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d MMM yyyy")]
    return F.coalesce(*tries, F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"), F.lit(NO_DATE).cast("date"))


def parse_epoch(c: Column) -> Column:
    """FN1 on numbers: seconds since the epoch, in UTC."""
    return F.coalesce(F.to_date(F.timestamp_seconds(c.cast("long"))), F.lit(NO_DATE).cast("date"))


def parse_minor(c: Column) -> Column:
    """FN2 on text: with a point major units, half to even; without one minor units; what doesn't parse is 0."""
    s = F.trim(F.regexp_replace(c.cast("string"), "[,₹]", ""))
    negative = s.startswith("(") & s.endswith(")")
    body = F.regexp_replace(s, r"^[()]+|[()]+$", "")
    value = F.when(body.contains("."), F.rint(F.expr("1d") * body.try_cast("double") * 100).cast("long")).otherwise(F.when(F.trim(body).rlike(r"^[+-]?\d+$"), F.trim(body).try_cast("long")))
    value = F.coalesce(value, F.lit(0).cast("long"))
    return F.when(negative, -value).otherwise(value)


def major_to_minor(c: Column) -> Column:
    """FN2 on numbers with a fraction."""
    return F.rint(c * 100).cast("long")


def clean_ref(*columns: Column) -> Column:
    """FN3: the first that isn't blank, trimmed."""
    return F.coalesce(*[F.when(~F.trim(c).isin(BLANKS), F.trim(c)) for c in columns])


def mine_reference(c: Column) -> Column:
    """FN4: the first payout reference in a text, else the first order reference, in capitals."""
    found = [F.regexp_extract(c, rf"(?i)\b({p})\b", 1) for p in (r"UTR\d{8,}", r"ORD\d{5,}")]
    return F.upper(F.coalesce(*[F.when(f != "", f) for f in found]))


def dispute_state(c: Column) -> Column:
    """FN6: the dispute's state, null where unknown."""
    return _map(DISPUTE_NAMES)[F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))]


def currency_code(c: Column) -> Column:
    """FN8."""
    code = F.upper(F.trim(c))
    return F.coalesce(_map(ALIASES)[code], F.when(code.isin(list(MINOR_UNITS)), code), F.lit("INR"))


def minor_units(c: Column) -> Column:
    """FN9."""
    return F.coalesce(_map(MINOR_UNITS)[F.upper(c)], F.lit(100))


def format_money(minor: Column, currency: Column) -> Column:
    """FN10: sign, symbol and grouped digits (lakh and crore for INR), two decimals where the currency has any."""
    code = currency_code(currency)
    units = minor_units(code)
    fixed = F.when(units > 1, F.format_string("%.2f", F.abs(minor) / units)).otherwise(F.format_string("%d", F.abs(minor)))
    whole, rest = F.substring_index(fixed, ".", 1), F.when(fixed.contains("."), F.concat(F.lit("."), F.substring_index(fixed, ".", -1))).otherwise("")
    grouped = F.when(code == "INR", F.regexp_replace(whole, r"(\d)(?=(\d\d)+\d$)", "$1,")).otherwise(F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1,"))
    symbol = F.coalesce(_map(SYMBOLS)[code], F.concat(code, F.lit(" ")))
    return F.concat(F.when(minor < 0, "-").otherwise(""), symbol, grouped, rest)


def compact_money(minor: Column, currency: Column) -> Column:
    """FN11: crores and lakhs for INR, billions, millions and thousands elsewhere."""
    code = currency_code(currency)
    value = F.abs(minor) / minor_units(code)
    inr = F.when(value >= 1e7, F.format_string("%.2fCr", value / 1e7)).when(value >= 1e5, F.format_string("%.2fL", value / 1e5))
    other = F.when(value >= 1e9, F.format_string("%.2fB", value / 1e9)).when(value >= 1e6, F.format_string("%.2fM", value / 1e6)).when(value >= 1e3, F.format_string("%.2fK", value / 1e3))
    symbol = F.coalesce(_map(SYMBOLS)[code], F.concat(code, F.lit(" ")))
    return F.concat(F.when(minor < 0, "-").otherwise(""), symbol, F.coalesce(F.when(code == "INR", inr).otherwise(other), F.format_string("%.2f", value)))


PROVENANCE = ["actual", "absent", "estimated"]


def add_amounts(a: Column, b: Column, sign: int = 1) -> Column:
    """FN12 on structs (minor, currency, provenance): null across currencies; the weaker provenance spreads."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, PROVENANCE)), x["provenance"])
    provenance = F.element_at(F.array(*map(F.lit, PROVENANCE)), F.greatest(rank(a), rank(b)).cast("int"))
    return F.when(a["currency"] == b["currency"], F.struct((a["minor"] + sign * b["minor"]).alias("minor"), a["currency"].alias("currency"), provenance.alias("provenance")))


def divide_half_away(n: Column, d: int) -> Column:
    """FN13: integer division, halves away from zero; by 0 gives 0. All in BIGINT."""
    if d == 0:
        return F.lit(0).cast("long")
    size = F.call_function("div", 2 * F.abs(n) + abs(d), F.lit(2 * abs(d)))
    return (size if d > 0 else -size) * F.when(n < 0, -1).otherwise(1)


def rate_of(minor: Column, bps: Column) -> Column:
    """FN16 and the percentage part of FN14: basis points of an amount."""
    return divide_half_away(minor * bps, 10_000)


def tokens(c: Column) -> Column:
    """FN21: the set of runs of three or more letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """FN22, of arrays without repeats as :func:`tokens` gives them."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def exception_key(id_: Column, category: Column, amount: Column, currency: Column) -> Column:
    """FN26."""
    return F.concat_ws("|", id_, category, amount.cast("string"), currency)


# Fixed values.
HIGH_VALUE = ["missing_in_bank", "over_refunded", "orphan_chargeback"]
LOW = ["payout_in_transit", "duplicate"]


def priority(category: Column, amount: Column) -> Column:
    """FN27."""
    return (
        F.when(category.isin(HIGH_VALUE) & (amount >= 100_000), "critical").when(category.isin(HIGH_VALUE), "high").when(amount >= 500_000, "high")
        .when(category.isin(LOW), "low").otherwise("medium")
    )


def prompt_text(c: Column) -> Column:
    """FN28."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), 1, 120)


def confidence(c: Column) -> Column:
    """FN29: a number held to 0..1; anything else is 0."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x < 0), 0.0).otherwise(F.least(x, F.lit(1.0)))


def json_reply(c: Column, schema: str) -> Column:
    """FN30: the outermost object of a reply, fences and prose around it ignored; null where it doesn't parse."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)


def safe_name(c: Column) -> Column:
    """FN31."""
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), 1, 80)


def digest16(values: Column) -> Column:
    """FN24 and FN25: the first 16 hex digits of the SHA-256 of sorted values."""
    return F.substring(F.sha2(F.array_join(F.array_sort(values), "\n"), 256), 1, 16)


