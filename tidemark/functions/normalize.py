"""Text to typed values, one Column expression each; what does not fit becomes NULL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mean "missing".
MISSING = ["", "na", "n/a", "nan", "null", "nat"]
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: Price limit rates.
ST_RATE, GROWTH_RATE, NORTH_RATE, PLAIN_RATE = Decimal("0.05"), Decimal("0.20"), Decimal("0.30"), Decimal("0.10")


def normalize_text(c: Column) -> Column:
    """white space (Unicode) at the ends dropped, inside collapsed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_missing(c: Column) -> Column:
    """F1"""
    return c.isNull() | F.lower(normalize_text(c)).isin(MISSING)


def first_value(*aliases: Column) -> Column:
    """The first alias that is not empty."""
    return F.coalesce(*[F.nullif(normalize_text(a), F.lit("")) for a in aliases])


def normalize_date(c: Column) -> Column:
    """yyyy-M-d, yyyy/M/d, yyyy.M.d or yyyyMMdd, and a day that exists."""
    t = normalize_text(c)
    forms = [(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"), (r"^\d{8}$", "yyyyMMdd")]
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_date(t, f)) for p, f in forms])


def strict_date(c: Column) -> Column:
    """yyyy-MM-dd only."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def normalize_code(c: Column) -> Column:
    """market prefix, optional dot, six digits, any case."""
    t, pattern = normalize_text(c), r"^(?i)(sh|sz|bj)\.?(\d{6})$"
    return F.when(t.rlike(pattern), F.concat_ws(".", F.lower(F.regexp_extract(t, pattern, 1)), F.regexp_extract(t, pattern, 2)))


def parse_decimal(c: Column, scale: int = 10) -> Column:
    """thousands separators dropped; values beyond DECIMAL(38, scale) count as malformed."""
    t = F.regexp_replace(normalize_text(c), ",", "")
    return F.when((F.length(t) <= 1000) & t.rlike(NUMBER), t.try_cast(f"decimal(38,{scale})"))


def normalize_decimal(c: Column, places: int) -> Column:
    """half up."""
    return F.round(parse_decimal(c), places)


def normalize_integer(c: Column) -> Column:
    """F8: numbers equal to their whole part."""
    d = parse_decimal(c)
    return F.when(d == F.floor(d), d.cast("long"))


def parse_number(c: Column, commas: bool = True) -> Column:
    """A finite double; the pattern comes before the cast, which would take nan and 1e400."""
    t = F.regexp_replace(normalize_text(c), ",", "") if commas else normalize_text(c)
    x = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(x) != float("inf"), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b - 1, NULL if b is 0."""
    return F.try_divide(a, b) - 1


def clip(x: Column, low, high) -> Column:
    """F15"""
    return F.least(F.greatest(x, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def sigmoid(x: Column) -> Column:
    """F16"""
    e = F.exp(-F.abs(F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0))))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def floor_to_lot(shares: Column, lot: int) -> Column:
    """F17"""
    return F.when(shares <= 0, F.lit(0)).otherwise(F.floor(shares / lot) * lot).cast("long")


def limit_rate(code: Column, is_st: Column) -> Column:
    """special treatment, growth boards, north board, the rest; in this order."""
    growth = code.startswith("sh.688") | code.startswith("sz.300")
    return F.when(is_st, F.lit(ST_RATE)).when(growth, F.lit(GROWTH_RATE)).when(code.startswith("bj."), F.lit(NORTH_RATE)).otherwise(F.lit(PLAIN_RATE))


#: Decimal places of a bar's fields, and its whole-number and text fields.
DAILY_DECIMALS = {"open": 4, "high": 4, "low": 4, "close": 4, "preclose": 4, "amount": 2, "turn": 6, "pctChg": 6}
DAILY_INTEGERS = ["volume", "tradestatus", "isST", "adjustflag"]
DAILY_TEXTS = ["code_name", "industry_code", "industry_name", "adjustment", "data_source"]
CONSTITUENT_TEXTS = ["code_name", "industry_code", "industry_name", "classification"]


def _all_known(names: list[str]) -> Column:
    known = F.lit(True)
    for name in names:
        known = known & F.col(name).isNotNull()
    return known


def _texts(names: list[str]) -> dict[str, Column]:
    shape = {"industry_code": F.upper, "adjustment": F.lower}
    return {n: shape.get(n, lambda c: c)(normalize_text(F.col(n))) for n in names}


def normalize_daily(rows: DataFrame) -> DataFrame:
    """typed bars of text rows, and valid: whether every field is (a row counts as a whole or not at all)."""
    typed = {"date": normalize_date(F.col("date")), "code": normalize_code(F.col("code"))}
    typed |= {n: normalize_decimal(F.col(n), p) for n, p in DAILY_DECIMALS.items()} | {n: normalize_integer(F.col(n)) for n in DAILY_INTEGERS} | _texts(DAILY_TEXTS)
    return rows.select(*[c.alias(n) for n, c in typed.items()]).withColumn("valid", _all_known(list(typed)))


def normalize_constituents(rows: DataFrame) -> DataFrame:
    """the same for constituents."""
    typed = {"code": normalize_code(F.col("code")), **_texts(CONSTITUENT_TEXTS), "updateDate": normalize_date(F.col("updateDate"))}
    return rows.select(*[c.alias(n) for n, c in typed.items()]).withColumn("valid", _all_known(list(typed)))


def at_least(value, least, name: str):
    """a parameter that must not be smaller."""
    if value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value
