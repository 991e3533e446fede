"""Texts made of and taken from values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Driver of a run by the prefix of its name.
DRIVERS = {"M": "B", "S": "A", "Y": "D", "Vf": "E", "Vta": "E", "Vtb": "E", "Vw": "E"}


def distance(metres: Column) -> Column:
    """Whole metres, from a kilometre on kilometres with two places."""
    return F.when(metres >= 1000, F.format_string("%.2f km", metres / 1000)).otherwise(F.format_string("%.0f m", metres))


def duration(seconds: Column) -> Column:
    """Minutes and seconds, from an hour on hours too."""
    s = seconds.cast("long")
    whole = lambda x, n: F.floor(x / n).cast("long")
    return F.when(s < 3600, F.format_string("%d:%02d", whole(s, 60), s % 60)).otherwise(F.format_string("%d:%02d:%02d", whole(s, 3600), whole(s % 3600, 60), s % 60))


def count(n: Column) -> Column:
    """Thousands and millions with one place."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fk", n / 1000)).otherwise(n.cast("string"))


def session_date(session_id: Column) -> Column:
    """The date in a session's id, or the id itself where it holds none."""
    at = F.try_to_timestamp(session_id, F.lit("yyyyMMdd_HHmmss"))
    return F.coalesce(F.date_format(at, "MMM d, yyyy · HH:mm"), session_id)


def driver(run: Column) -> Column:
    """Driver of a run: by the longest prefix of what stands before ``_r``; ``?`` for none."""
    base, out = F.split_part(run, F.lit("_r"), F.lit(1)), None
    for prefix in sorted(DRIVERS, key=lambda p: (-len(p), p)):
        out = F.when(base.startswith(prefix), DRIVERS[prefix]) if out is None else out.when(base.startswith(prefix), DRIVERS[prefix])
    return out.otherwise("?")


def label(text: Column) -> Column:
    """What stands before `` (``; the whole text where that is missing."""
    return F.split_part(text, F.lit(" ("), F.lit(1))


def from_template(template: str, **values: Column) -> Column:
    """A URL template with ``{name}`` replaced, values URL-encoded."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.url_encode(value.cast("string")))
    return out


def cache_key(query: Column) -> Column:
    """The first eight hex digits of the SHA-1."""
    return F.substring(F.sha1(query), 1, 8)
