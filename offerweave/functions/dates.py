"""Times as text and ages of prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(ts: Column) -> Column:
    """UTC to the second; '' if null. The session's time zone must be UTC."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def price_age(ts: Column, as_of: Column) -> Column:
    """danas, juče, then days, weeks from a week on; null without a time."""
    days = F.datediff(as_of, ts)
    plural = lambda n, one, few, many: F.when((n % 10 == 1) & (n % 100 != 11), F.lit(one)).when(
        (n % 10).between(2, 4) & ~(n % 100).between(12, 14), F.lit(few)
    ).otherwise(F.lit(many))
    weeks = F.floor(days / 7)
    say = lambda n, word: F.concat(F.lit("pre "), n.cast("string"), F.lit(" "), word)
    return (
        F.when(days <= 0, F.lit("danas"))
        .when(days == 1, F.lit("juče"))
        .when(days < 7, say(days, plural(days, "dan", "dana", "dana")))
        .otherwise(say(weeks, plural(weeks, "nedelju", "nedelje", "nedelja")))
    )
