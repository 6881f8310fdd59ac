"""Money, similarity scores, confidence and dates as Column expressions (NUM, DAT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence labels as numbers, and the bands of release actions with their gaps.
LABEL_SCORE = {"high": 0.90, "medium": 0.80, "low": 0.30}
BANDS = ((0.90, 1.01, "auto_release"), (0.85, 0.89, "auto_release_medium"), (0.70, 0.84, "hold_governance_review"), (0.0, 0.70, "quarantine"))


def _unit(u: Column) -> Column:
    u = F.lower(u)
    return F.when(u.isin("billion", "b"), 1e9).when(u.isin("million", "m"), 1e6).when(u.isin("thousand", "k"), 1e3).otherwise(1.0)


def parse_aum(text: Column) -> Column:
    """A free-text size as (amount, measure_type, as_of, source); null if it has no dollar figure. (NUM-01)

    The date is read only where "as of" is followed by a year or an ISO date, so texts with MM-DD-YYYY have no date.
    """
    figure = r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(billion|million|thousand|[BbMmKk]|)\b"
    number = F.regexp_extract(text, figure, 1)
    amount = F.replace(number, F.lit(","), F.lit("")).try_cast("double") * _unit(F.regexp_extract(text, figure, 2))
    low = F.lower(text)
    thirteen = low.contains("13(f)") | low.contains("13f")
    adviser = low.contains("adv") | low.contains("regulatory aum")
    kind = F.when(thirteen, "13F_securities_value").when(adviser, "regulatory_aum").otherwise("unknown")
    source = F.when(thirteen, "SEC Form 13F").when(adviser, "SEC Form ADV")
    day, year = F.regexp_extract(text, r"as of (\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(text, r"as of (\d{4})", 1)
    as_of = F.coalesce(F.nullif(day, F.lit("")), F.nullif(year, F.lit("")))
    return F.when(number != "", F.struct(F.round(amount, 2).alias("amount"), kind.alias("measure_type"), as_of.alias("as_of"), source.alias("source")))


def parse_aum_usd(text: Column) -> Column:
    """The leading dollar figure as a whole number; units need no word border. (NUM-02)"""
    figure = r"(?i)\$\s*([\d,.]+)\s*(billion|million|thousand|b|m|k)?"
    number = F.replace(F.regexp_extract(text, figure, 1), F.lit(","), F.lit("")).try_cast("double")
    return (number * _unit(F.regexp_extract(text, figure, 2))).cast("long")


def sortable_aum(text: Column) -> Column:
    """As parse_aum_usd(), with -1 for what is missing. (NUM-03)"""
    return F.coalesce(parse_aum_usd(text), F.lit(-1).cast("long"))


def human_usd(v: Column, billions: int = 2, millions: int = 1) -> Column:
    """$x.xxB, $x.xM or $x,xxx. (NUM-04)"""
    return (
        F.when(v >= 1e9, F.format_string(f"$%.{billions}fB", (v / 1e9).cast("double")))
        .when(v >= 1e6, F.format_string(f"$%.{millions}fM", (v / 1e6).cast("double")))
        .when(v.isNotNull(), F.concat(F.lit("$"), F.format_number(v, 0)))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length, 1 for a zero vector."""
    length = F.sqrt(dot(a, a))
    return F.when(length == 0, F.lit(1.0)).otherwise(length)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the normalised vectors. (NUM-05)"""
    return dot(a, b) / (norm(a) * norm(b))


def rrf(ranks: list[Column], k: int = 60) -> Column:
    """Reciprocal rank fusion of ranks from 0; a null rank gives nothing. (NUM-07)"""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(F.lit(1.0) / (F.lit(k) + r), F.lit(0.0))
    return total


def confidence_score(value: Column) -> Column:
    """A label or a number as 0 to 1; numbers above 1 are percentages; what is unknown counts as low. (NUM-09)"""
    label = F.lower(F.trim(value.cast("string")))
    number = F.trim(value.cast("string")).try_cast("double")
    scored = F.when(number > 1, number / 100).otherwise(number)
    for name, score in LABEL_SCORE.items():
        scored = F.when(label == name, F.lit(score)).otherwise(scored)
    return F.coalesce(scored, F.when(value.isNull(), F.lit(0.0)).otherwise(F.lit(0.30)))


def release_band(confidence: Column) -> Column:
    """The action of the band that holds a confidence; what is in no band is quarantined. (NUM-10)"""
    action = F.lit("quarantine")
    for low, high, name in reversed(BANDS):
        action = F.when((confidence >= low) & (confidence < high), name).otherwise(action)
    return action


def ratio(part: Column, whole: Column, digits: int = 4, scale: float = 1.0) -> Column:
    """part over whole times scale, rounded; 0 where there is no whole. (NUM-11)"""
    return F.coalesce(F.round(F.try_divide(part * F.lit(scale), whole.cast("double")), digits), F.lit(0.0))


def period_date(c: Column) -> Column:
    """MM-DD-YYYY as a date, null if it is none. (DAT-01)"""
    return F.when(c.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_timestamp(c, F.lit("MM-dd-yyyy")).cast("date"))


def is_fresh(period: Column, as_of: Column, most_days: int = 760) -> Column:
    """Whether a filing period is recent enough. (DAT-02)"""
    return F.coalesce(F.date_diff(as_of, period) <= most_days, F.lit(False))


def days_since(c: Column, as_of: Column) -> Column:
    """Days from an ISO date to as_of, null if it is none. (DAT-03)"""
    return F.date_diff(as_of, iso_date(c))


def iso_date(c: Column, default: Column | None = None) -> Column:
    """An ISO date, or default. (DAT-05)"""
    day = F.when(c.cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd")).cast("date"))
    return day if default is None else F.coalesce(day, default)


def seen_date(c: Column) -> Column:
    """The date that the first eight digits of a news time stamp give. (DAT-04)"""
    eight = F.substring(c, 1, 8)
    return F.when(eight.rlike(r"^\d{8}$"), F.try_to_timestamp(eight, F.lit("yyyyMMdd")).cast("date"))


def filing_year(c: Column) -> Column:
    """The year behind a slash. (DAT-07)"""
    return F.regexp_extract(c, r"/(\d{4})", 1).try_cast("int")


def cron_hours(field: str) -> list[int]:
    """Hours of a cron field: numbers, ranges, steps, lists. (DAT-06)"""
    hours: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        low, _, high = ("0", "-", "23") if span == "*" else span.partition("-")
        last = int(high or (23 if step else low))
        hours.update(range(int(low), last + 1, int(step or 1)))
    return sorted(h for h in hours if 0 <= h < 24)


def is_every_two_hours(field: str) -> bool:
    hours = cron_hours(field)
    return len(hours) == 12 and all(b - a == 2 for a, b in zip(hours, hours[1:], strict=False))


def planned_cycles(hours: float, minutes: float) -> int:
    """Cycles that fit into a budget of hours. (AGG-29)"""
    return max(1, int(hours * 60 // max(minutes, 0.1)) - 1)
