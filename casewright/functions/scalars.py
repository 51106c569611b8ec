"""Column rules for report fields. Every function takes and returns Spark columns; null and "" mean missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIOUSNESS_FLAGS = (
    "serious",
    "seriousnessdeath",
    "seriousnesslifethreatening",
    "seriousnesshospitalization",
    "seriousnessdisabling",
    "seriousnesscongenitalanomali",
    "seriousnessother",
)
LABEL = "label_serious"
LEAKAGE_FIELDS = (*SERIOUSNESS_FLAGS, LABEL)

# Years in one unit of the report format's age codes.
YEARS_PER_UNIT = {
    "800": 10.0,
    "801": 1.0,
    "802": 1.0 / 12.0,
    "803": 1.0 / 52.1429,
    "804": 1.0 / 365.25,
    "805": 1.0 / 8766.0,
    "806": 1.0 / 525960.0,
}
MAX_AGE_YEARS = 130
TOKEN_CHARS = 120


#: White space as patterns know it.
BLANKS = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    """Without white space at either end; null gives ""."""
    return F.coalesce(F.trim(text, F.lit(BLANKS)), F.lit(""))


def parse_float(text: Column) -> Column:
    """The whole text as a number, commas ignored; else its first plain number; else null."""
    return number_in(strip(text))


def number_in(clean: Column) -> Column:
    """parse_float of a stripped text, which is named several times: give a column that is there already."""
    whole = F.when(~F.contains(F.lower(clean), F.lit("x")), F.replace(clean, F.lit(","), F.lit("")).try_cast("double"))
    first = F.nullif(F.regexp_extract(clean, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")
    return F.coalesce(whole, first)


def _plain(x: Column) -> Column:
    """Whether x is a number of at most three places and six digits, which rounds to itself."""
    return (F.abs(x) < 1000.0) & (x * 1000.0 == F.rint(x * 1000.0))


def long_form(x: Column) -> Column:
    """Seventeen digits of x; null for a number that needs no rounding."""
    return F.when(~_plain(x), F.format_string("%.16e", x))


def short_form(text: Column, x: Column) -> Column:
    """x, whose long_form is text, rounded to six significant digits; NaN and infinities give null.

    A number whose shortest decimal text ends in a lone 5 at the seventh digit goes to the even digit, as it does
    where the tie is exact (means of eighths and so on)."""
    to_even = text.rlike(r"^-?[0-9]\.[0-9]{4}[02468]50*e")
    rounded = F.when(to_even, F.regexp_replace(text, "50*e", "e")).otherwise(F.format_string("%.5e", x))
    return F.when(_plain(x), F.rint(x * 1000.0) / 1000.0).when(F.abs(x) < float("inf"), rounded.try_cast("double"))


def round6(x: Column) -> Column:
    """Rounded to six significant digits. For several numbers of a table use with_round6, which names each step once."""
    return short_form(long_form(x), x)


def with_round6(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns rounded to six significant digits, step by step, so that no step's expression is repeated."""
    steps = df.withColumns({f"_x_{n}": c for n, c in columns.items()})
    steps = steps.withColumns({f"_t_{n}": long_form(F.col(f"_x_{n}")) for n in columns})
    done = steps.withColumns({n: short_form(F.col(f"_t_{n}"), F.col(f"_x_{n}")) for n in columns})
    return done.drop(*[f"_{p}_{n}" for n in columns for p in "xt"])


def parse_date(text: Column) -> Column:
    """The date in the first eight digits, yyyymmdd; null unless that is a day of the calendar."""
    head = F.left(strip(text), F.lit(8))
    day = F.concat_ws("-", F.left(head, F.lit(4)), F.substring(head, 5, 2), F.substring(head, 7, 2))
    return F.when(head.rlike("^[0-9]{8}$") & (F.left(head, F.lit(4)) != "0000"), day.try_cast("date"))


def unit_years(code: Column) -> Column:
    """Years in one unit, by its stripped code; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in YEARS_PER_UNIT.items() for x in pair]), code)


def age_years(age: Column, unit: Column) -> Column:
    """Age in years to six digits; null for a negative age, an unknown unit or more than MAX_AGE_YEARS."""
    return round6(in_bounds(parse_float(age), unit_years(strip(unit))))


def in_bounds(value: Column, factor: Column) -> Column:
    return F.when((value >= 0) & (value * factor <= MAX_AGE_YEARS), value * factor)


def age_bin(years: Column) -> Column:
    return F.when(years.isNull(), "unknown").when(years < 18, "child").when(years < 65, "adult").otherwise("senior")


def count_bin(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x <= 0, "0").when(x == 1, "1").when(x <= 4, "2_4").when(x <= 9, "5_9").otherwise("10_plus")


def normalize_text(text: Column) -> Column:
    """Upper case, every run of other characters than A-Z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+", " "))


def make_token(prefix: str, text: Column) -> Column:
    """prefix:VALUE of at most TOKEN_CHARS in VALUE; "" for what normalises to nothing."""
    return normal_token(prefix, normalize_text(text))


def normal_token(prefix: str, normal: Column) -> Column:
    """make_token of a normalised text."""
    cut = F.left(F.replace(normal, F.lit(" "), F.lit("_")), F.lit(TOKEN_CHARS))
    return F.when(normal != "", F.concat(F.lit(f"{prefix}:"), cut)).otherwise("")


def joined_token(prefix: str, text: Column) -> Column:
    """prefix:VALUE, uncut; the bare prefix for a text that normalises to nothing."""
    return normal_joined(prefix, normalize_text(text))


def normal_joined(prefix: str, normal: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.replace(normal, F.lit(" "), F.lit("_")))


def substance_name(substances: Column) -> Column:
    """The first of an array of names that normalises to something; else ""."""
    named = F.filter(F.transform(substances, normalize_text), lambda x: x != "")
    return F.coalesce(F.get(named, F.lit(0)), F.lit(""))


def canonical_drug(substances: Column, product: Column) -> Column:
    """The active substance's name, else the product's, normalised."""
    substance = substance_name(substances)
    return F.when(substance != "", substance).otherwise(normalize_text(product))


def label_from_flags(flags: dict[str, Column] | None = None) -> Column:
    """1 if any seriousness flag is "1", else 0."""
    columns = [F.col(f) for f in SERIOUSNESS_FLAGS] if flags is None else list(flags.values())
    return F.when(reduce(lambda a, b: a | b, [strip(c) == "1" for c in columns]), 1).otherwise(0)


def quarter_split(quarter: Column) -> Column:
    """train for the first three quarters of a year; the fourth waits for its split."""
    return F.when(F.right(quarter, F.lit(1)).cast("int") <= 3, "train").otherwise("q4_pending")


def report_id_keys(report_id: Column) -> list[Column]:
    """Sort keys: ids of digits first, by value and of any length, then the others by text."""
    text = F.coalesce(report_id, F.lit(""))
    digits = text.rlike("^[0-9]+$")
    bare = F.ltrim(text, F.lit("0"))
    return [F.when(digits, 0).otherwise(1), F.when(digits, F.length(bare)).otherwise(0), F.when(digits, bare).otherwise(text)]


def pct(num: Column, den: Column) -> Column:
    return F.try_divide(F.lit(100.0) * num, den)
