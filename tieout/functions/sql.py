"""SQL names of the parsing and money functions: temporary SQL functions, which the optimiser puts in place of each call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tieout.functions.scalars import ALIASES, MINOR_UNITS, NO_DATE, SYMBOLS


def _map(values: dict) -> str:
    return "map(" + ", ".join(f"'{k}', {v if isinstance(v, int) else repr(v)}" for k, v in values.items()) + ")"


#: name -> (arguments, type, expression); later ones may call earlier ones.
FUNCTIONS = {
    "plain_amount": ("s STRING", "STRING", "trim(regexp_replace(s, '[,₹]', ''))"),
    "amount_body": ("s STRING", "STRING", "regexp_replace(plain_amount(s), r'^[()]+|[()]+$', '')"),
    "body_to_minor": (
        "s STRING", "BIGINT",
        r"coalesce(CASE WHEN contains(s, '.') THEN CAST(rint(try_cast(s AS DOUBLE) * 100) AS BIGINT) WHEN trim(s) RLIKE r'^[+-]?\d+$' THEN try_cast(trim(s) AS BIGINT) END, 0L)",
    ),
    "parse_minor": ("s STRING", "BIGINT", "CASE WHEN startswith(plain_amount(s), '(') AND endswith(plain_amount(s), ')') THEN -body_to_minor(amount_body(s)) ELSE body_to_minor(amount_body(s)) END"),
    "parse_day": (
        "s STRING", "DATE",
        "coalesce(" + ", ".join(f"try_to_date(trim(s), '{f}')" for f in ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d MMM yyyy")) + f", try_to_date(substr(trim(s), 1, 10), 'yyyy-MM-dd'), DATE'{NO_DATE}')",
    ),
    "divide_half_away": ("n BIGINT, d BIGINT", "BIGINT", "CASE WHEN d = 0 THEN 0L ELSE ((2 * abs(n) + abs(d)) div (2 * abs(d))) * CASE WHEN (n < 0) = (d < 0) THEN 1 ELSE -1 END END"),
    "currency_of": ("c STRING", "STRING", f"coalesce({_map(ALIASES)}[upper(trim(c))], CASE WHEN upper(trim(c)) IN ({', '.join(map(repr, MINOR_UNITS))}) THEN upper(trim(c)) END, 'INR')"),
    "units_of": ("c STRING", "INT", f"coalesce({_map(MINOR_UNITS)}[upper(c)], 100)"),
    "fixed_amount": ("minor BIGINT, c STRING", "STRING", "CASE WHEN units_of(c) > 1 THEN format_string('%.2f', abs(minor) / units_of(c)) ELSE format_string('%d', abs(minor)) END"),
    "grouped_amount": (
        "fixed STRING, c STRING", "STRING",
        r"regexp_replace(substring_index(fixed, '.', 1), CASE WHEN c = 'INR' THEN r'(\d)(?=(\d\d)+\d$)' ELSE r'(\d)(?=(\d{3})+$)' END, '$1,') || CASE WHEN contains(fixed, '.') THEN '.' || substring_index(fixed, '.', -1) ELSE '' END",
    ),
    "format_money": (
        "minor BIGINT, c STRING", "STRING",
        f"CASE WHEN minor < 0 THEN '-' ELSE '' END || coalesce({_map(SYMBOLS)}[currency_of(c)], currency_of(c) || ' ') || grouped_amount(fixed_amount(minor, currency_of(c)), currency_of(c))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """FN1, FN2, FN10 and FN13 for SQL: creates the session's functions and gives their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
