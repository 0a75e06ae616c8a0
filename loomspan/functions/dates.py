"""Dates of the news pipeline and dates written as free text, inside whole-stage codegen.

Each kind of text is read by one expression with named groups; what it captures
is then put together by rules on the captured parts.
"""

from __future__ import annotations

import calendar
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEP = "\u0001"


def _captured(text: Column, pattern: str, groups: Sequence[str]) -> Column:
    """Array of the groups of a text that matches as a whole (after an empty entry), else of one entry."""
    return F.split(F.regexp_replace(text, F.lit(f"(?s)^(?:{pattern})$"), F.lit(_SEP + _SEP.join(f"${{{g}}}" for g in groups))), _SEP)


# ---- dates of articles ----------------------------------------------------------
_ARTICLE = r"(?<y>\d{4})-(?<m>\d\d)-(?<d>\d\d)(?:T(?<h>\d\d):(?<mi>\d\d):(?<s>\d\d(?:\.\d{1,6})?)(?:(?<z>Z)|(?<oh>[+-]\d\d):?(?<om>\d\d)(?:\[[^\]]*\])?))?"


def publishing_date(text: Column, crawltime: Column) -> Column:
    """A timestamp from ``yyyy-MM-dd`` or an ISO time with offset (a zone name in brackets may follow), else ``crawltime``.

    A date alone is its midnight in the session's zone.  Dates and times that
    don't exist are read as ``crawltime`` too.
    """
    names = ["y", "m", "d", "h", "mi", "s", "oh", "om", "z"]
    p = _captured(text, _ARTICLE, names)
    part = {n: F.get(p, F.lit(i + 1)) for i, n in enumerate(names)}
    whole = lambda n: F.coalesce(F.nullif(part[n], F.lit("")), F.lit("0")).cast("int")
    zone = F.when(part["h"] == "", F.current_timezone()).when(part["z"] == "Z", F.lit("+00:00")).otherwise(F.concat(part["oh"], F.lit(":"), part["om"]))
    second = F.coalesce(F.nullif(part["s"], F.lit("")), F.lit("0")).cast("decimal(8,6)")
    made = F.try_make_timestamp(whole("y"), whole("m"), whole("d"), whole("h"), whole("mi"), second, zone)
    return F.coalesce(F.when(F.size(p) > 1, made), crawltime)


def social_date(text: Column) -> Column:
    """A timestamp from ``Wed Oct 10 20:19:24 +0000 2018``, or null."""
    shape = r"^\w{3} (\w{3} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4})$"
    return F.when(text.rlike(shape), F.try_to_timestamp(F.regexp_extract(text, shape, 1), F.lit("MMM dd HH:mm:ss xx yyyy")))


# ---- ranges of days in free text ------------------------------------------------------
# Words for an end that hasn't come.
NOW = ("present", "ongoing", "now")
_MONTH, _WEEKDAY = ("|".join(x.lower() for x in names if x) for names in (calendar.month_name, calendar.day_name))
_DAY = r"0?[1-9]|[12]\d|3[01]"
# One end of a range: a day may come before or after the month, a weekday or hour before a whole date, an age after it.
_END = (
    rf"(?:(?<now{{k}}>{'|'.join(NOW)})|(?:(?<pre{{k}}>{_WEEKDAY}|[0-5]?\d:[0-5]\d)\s+)?(?:(?<a{{k}}>{_DAY})\b\s*)?(?:(?<m{{k}}>{_MONTH})\b\s*)?"
    rf"(?:(?<b{{k}}>{_DAY})\b\s*)?(?:(?<y{{k}}>[12]\d{{{{3}}}})\b\s*)?(?<ago{{k}}>;\s+\d+\s+(?:days|months|years)\s+ago)?)"
)
_RANGE = _END.format(k="1") + r"\s*(?:(?<dash>-)\s*" + _END.format(k="2") + ")?"
_PARTS = ["dash", *[f"{n}{k}" for k in "12" for n in ("now", "pre", "a", "m", "b", "y", "ago")]]


def _cleaned(text: Column) -> Column:
    """Lower case, one kind of dash, no commas and brackets; the first line, with those after it as long as lines end in a dash."""
    t = F.lower(F.trim(F.regexp_replace(F.translate(text, "\u00a0–—,", " -- "), r"\([^)]*\)", "")))
    t = F.regexp_replace(t, r"^total:", "")
    t = F.regexp_replace(t, r"(?s)^((?:[^\n]*-\s*\n)*[^\n]*).*$", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def free_text_range(text: Column, ref_date: Column) -> Column:
    """[first, last] day of a date or range written as text, or null; the last is 'NOW' if it goes on.

    What is in brackets is left aside, and so are further lines unless a line
    ends in a dash.  A year missing at the start is that of the end; missing
    altogether it is that of ``ref_date`` (yyyy-MM-dd).  A month or year alone
    stands for all its days.  Days that don't exist make no range.
    """
    ref = F.when(ref_date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(ref_date, 1, 4).cast("int"))
    month_no = F.create_map(*[F.lit(x) for i, m in enumerate(calendar.month_name) if m for x in (m.lower(), i)])

    def ends(p: Column) -> Column:
        got = {n: F.nullif(F.get(p, F.lit(i + 1)), F.lit("")) for i, n in enumerate(_PARTS)}
        has = lambda n: got[n].isNotNull()
        parts = [has("dash").alias("dash"), (F.size(p) > 1).alias("read"), ref.alias("ref")]
        for k in "12":
            parts += [
                F.coalesce(got[f"a{k}"], got[f"b{k}"]).cast("int").alias(f"d{k}"), F.try_element_at(month_no, got[f"m{k}"]).alias(f"m{k}"), got[f"y{k}"].cast("int").alias(f"y{k}"),
                has(f"now{k}").alias(f"now{k}"), (has(f"a{k}") & has(f"b{k}")).alias(f"both{k}"), has(f"pre{k}").alias(f"pre{k}"), has(f"ago{k}").alias(f"ago{k}"), has(f"b{k}").alias(f"after{k}"),
            ]
        return F.struct(*parts)

    def kinds(e: Column) -> Column:
        parts = [e[x].alias(x) for x in ("dash", "read", "ref", "d1", "m1", "y1", "d2", "m2", "y2", "now2", "after1")]
        for k in "12":
            day, month, year, pre, ago = (e[f"{x}{k}"] for x in ("d", "m", "y", "pre", "ago"))
            dated = month.isNotNull() & (~pre | day.isNotNull()) & (~ago | (day.isNotNull() & year.isNotNull()))
            only_year = year.isNotNull() & month.isNull() & day.isNull() & ~pre & ~ago
            # A day with no month, as one side of two days of a month: before a dash, or after it with or without a year.
            bare = day.isNotNull() & month.isNull() & ~pre & ~ago
            parts += [((dated | only_year) & ~e[f"now{k}"] & ~e[f"both{k}"]).alias(f"whole{k}"), (bare & ~e[f"both{k}"]).alias(f"bare{k}"), (~pre & ~ago).alias(f"plain{k}")]
        return F.struct(*parts)

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    def chosen(e: Column) -> Column:
        """First and last day as numbers; no day in the last one stands for the end of its month, no year for NOW."""
        first = lambda y: day(y, F.coalesce(e["m1"], F.lit(1)), F.coalesce(e["d1"], F.lit(1)))
        last = lambda y, k: day(y, F.coalesce(e[f"m{k}"], F.lit(12)), e[f"d{k}"])
        nothing = F.lit(None).cast("int")
        own, since = F.coalesce(e["y1"], e["ref"]), F.coalesce(e["y1"], e["y2"], e["ref"])
        until, shared = F.coalesce(e["y2"], F.when(e["y1"].isNull(), e["ref"])), F.coalesce(e["y2"], e["ref"])
        left_bare = e["bare1"] & e["y1"].isNull() & e["whole2"] & e["plain2"] & e["d2"].isNotNull()
        right_bare = e["whole1"] & e["plain1"] & e["d1"].isNotNull() & e["after1"] & e["y1"].isNull() & e["bare2"]
        pair = (
            F.when(~e["read"], None)
            .when(~e["dash"], F.when(e["whole1"], F.array(first(own), last(own, "1"))))
            .when(e["whole1"] & e["now2"], F.when(e["y1"].isNotNull(), F.array(first(e["y1"]), day(nothing, nothing, nothing))))
            .when(e["whole1"] & e["whole2"], F.when(until.isNotNull(), F.array(first(since), last(until, "2"))))
            .when(left_bare, F.when(shared.isNotNull(), F.array(day(shared, e["m2"], e["d1"]), day(shared, e["m2"], e["d2"]))))
            .when(right_bare, F.when(shared.isNotNull(), F.array(day(shared, e["m1"], e["d1"]), day(shared, e["m1"], e["d2"]))))
        )
        return pair

    def written(x: Column) -> Column:
        start = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", x["y"], x["m"], F.coalesce(x["d"], F.lit(1))), F.lit("yyyy-MM-dd")).cast("date")
        return F.when(x["y"].isNull(), F.lit("NOW")).otherwise(F.date_format(F.when(x["d"].isNull(), F.last_day(start)).otherwise(start), "yyyy-MM-dd"))

    # Each step is bound to a variable of a higher-order function, so that it is worked out once.
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    pair = F.transform(let(let(let(_captured(_cleaned(text), _RANGE, _PARTS), ends), kinds), chosen), written)
    return let(pair, lambda p: F.when(F.forall(p, lambda x: x.isNotNull()) & (p[0] != "NOW"), p))
