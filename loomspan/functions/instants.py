"""Timestamps in many writings to one UTC instant, inside whole-stage codegen.

All writings are branches of one regular expression with named groups.  One
pass rewrites a text to its components; they are checked against the calendar
and put together by integer day arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names in six languages and their English short forms.
MONTHS = {
    1: "january januar jänner janvier enero gennaio januari jan",
    2: "february februar février fevrier febrero febbraio februari feb",
    3: "march märz maerz mars marzo maart mar",
    4: "april avril abril aprile apr",
    5: "may mai mayo maggio mei",
    6: "june juni juin junio giugno jun",
    7: "july juli juillet julio luglio jul",
    8: "august août aout agosto augustus aug",
    9: "september septembre septiembre settembre sept sep",
    10: "october oktober octobre octubre ottobre oct okt",
    11: "november novembre noviembre nov",
    12: "december dezember décembre decembre diciembre dicembre dec dez",
}
# Abbreviations that name UTC itself; that name a clock put forward; that name a standard clock.
UTC_NAMES = ["utc", "gmt", "z", "ut"]
FORWARD_NAMES = ["cest", "bst", "west", "eest", "msd", "edt", "cdt", "mdt", "pdt", "adt", "ndt", "aedt", "acdt", "nzdt"]
STANDARD_NAMES = ["cet", "wet", "eet", "msk", "est", "cst", "mst", "pst", "ast", "nst", "ist", "jst", "kst", "brt", "aest", "acst", "awst", "nzst", "sast", "pkt", "sgt", "hkt"]

_CLOCK = r"(?<h{i}>\d{{1,2}})[:hH](?<mi{i}>\d\d)(?::(?<s{i}>\d\d)(?:[.,](?<f{i}>\d{{1,9}}))?)?"
_ZONE = r"(?:\s*(?:(?:[Uu][Tt][Cc]|[Gg][Mm][Tt])?(?<o{i}>[+-]\d{{1,2}}(?::?\d\d)?)|(?<a{i}>[A-Za-z]{{1,5}}))(?:\s*\[[\w/+-]+\])?)?"
_HALF = r"(?:\s*(?<p{i}>[AaPp]\.?[Mm]\.?))?(?:\s+Uhr)?"
_BRANCHES = [
    r"(?<y{i}>\d{{4}})-(?<m{i}>\d\d)-(?<d{i}>\d\d)(?:(?:[Tt]|\s+)" + _CLOCK + _ZONE + ")?",
    r"(?<y{i}>\d{{4}})(?<m{i}>\d\d)(?<d{i}>\d\d)[Tt](?<h{i}>\d\d)(?<mi{i}>\d\d)(?:(?<s{i}>\d\d)(?:[.,](?<f{i}>\d{{1,9}}))?)?" + _ZONE,
    r"(?<y{i}>\d{{4}})[/.](?<m{i}>\d{{1,2}})[/.](?<d{i}>\d{{1,2}})(?:,?\s+" + _CLOCK + _HALF + _ZONE + ")?",
    r"(?<n1{i}>\d{{1,2}})[./-](?<n2{i}>\d{{1,2}})[./-](?<y{i}>\d{{4}})(?:,?\s+" + _CLOCK + _HALF + _ZONE + ")?",
    r"(?:\p{{L}}{{2,12}}\.?,?\s+)?(?<d{i}>\d{{1,2}})(?:\.|st|nd|rd|th|er|º)?\s+(?:de\s+)?(?<w{i}>\p{{L}}{{3,12}})\.?,?\s+(?:de\s+)?(?<y{i}>\d{{4}})(?:,?\s+(?:(?:à|um|at|om|alle|a las)\s+)?" + _CLOCK + _HALF + _ZONE + ")?",
    r"(?<w{i}>\p{{L}}{{3,12}})\.?\s+(?<d{i}>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<y{i}>\d{{4}})(?:,?\s+(?:at\s+)?" + _CLOCK + _HALF + _ZONE + ")?",
    r"(?<e{i}>-?\d{{9,19}})(?:[.,](?<f{i}>\d{{1,9}}))?",
]
_PARTS = ("y", "m", "d", "w", "n1", "n2", "h", "mi", "s", "f", "o", "a", "p", "e")
_LETTER = "ABCDEFGH"
#: The one alternation.
PATTERN = r"^[\s ]*(?:" + "|".join(b.format(i=_LETTER[k]) for k, b in enumerate(_BRANCHES)) + r")[\s ]*$"
_SEP = "\u0001"
#: A group outside the branch that matched gives the empty text, so the branches of a part can be put side by side.
_REWRITE = _SEP + _SEP.join("".join(f"${{{p}{_LETTER[k]}}}" for k, b in enumerate(_BRANCHES) if f"<{p}{{i}}>" in b) for p in _PARTS)


def instant_parts(text: Column) -> Column:
    """Array of the components of a text (index 0 empty), or of one entry where no writing matches."""
    return F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(_REWRITE)), _SEP)


def parts_to_utc_millis(df: DataFrame, parts: str, zone: str, order: str, out: str) -> DataFrame:
    """Add ``out``: milliseconds since 1970 of an ``instant_parts`` column, or null where it names no instant.

    Column ``zone`` (IANA names) is used where the text has no zone, and for
    zone abbreviations; where it is null, such a text names no instant.  Column
    ``order`` ('dmy', 'mdy', 'ymd') reads a numeric day and month; null reads as
    'dmy', and so does 'ymd' where the year comes last.  An offset in the text
    wins over a zone name in brackets after it.  A date alone is its midnight.
    Wall times that occur twice are the earlier instant, unless an abbreviation
    names the standard clock; wall times that don't occur are read with the
    offset before the change.  Finer digits than milliseconds are cut off.
    Null, empty and over-long texts, impossible dates and words name no instant.

    A whole number of 9 digits or more counts from 1970, back from it if
    negative: seconds below 10 ** 11 in size, else milliseconds below 10 ** 14,
    microseconds below 10 ** 17, and nanoseconds.  (So seconds are known from
    1973 to 5138, and milliseconds outside of those years' namesakes, 1966 to
    1973.)  Only seconds may have a fraction.  A shorter number is no instant.

    The steps are projections of their own, so that each value is worked out
    once and the generated code stays small.
    """
    at = {name: k + 1 for k, name in enumerate(_PARTS)}
    p = {name: F.get(F.col(parts), F.lit(k)) for name, k in at.items()}
    number = lambda text, kind="int": F.when(text != "", text.cast(kind))
    num = lambda name: number(p[name])
    c = lambda name: F.col(f"_i_{name}")
    step = lambda _df, **cols: _df.withColumns({f"_i_{k}": v for k, v in cols.items()})
    whole = lambda a, b: F.floor(a / b).cast("bigint")

    month_of = F.create_map(*[x for k, v in MONTHS.items() for w in v.split() for x in (F.lit(w), F.lit(k))])
    # The expression lets only digits into these parts, so that a cast needs no try: a failed try costs an exception.
    # A higher-order function ends a stage of generated code: the JVM never compiles methods above 8000 bytes.
    d = df.withColumn(parts, F.transform(F.col(parts), lambda x: F.trim(x)))
    d = step(d, od=F.regexp_replace(p["o"], "[^0-9]", ""))
    d = step(d, od=F.when(F.length("_i_od") % 2 == 1, F.concat(F.lit("0"), F.col("_i_od"))).otherwise(F.col("_i_od")))  # +2 and +530
    d = step(
        d,
        y=num("y"), m=num("m"), d=num("d"), n1=num("n1"), n2=num("n2"), w=F.when(p["w"] != "", F.try_element_at(month_of, F.lower(p["w"]))),
        mf=F.coalesce(F.col(order), F.lit("dmy")) == "mdy", half=F.lower(F.substring(p["p"], 1, 1)), h=F.coalesce(num("h"), F.lit(0)),
        mi=F.coalesce(num("mi"), F.lit(0)), s=F.coalesce(num("s"), F.lit(0)),
        f=F.when(p["f"] == "", 0).otherwise(F.substring(F.rpad(p["f"], 3, "0"), 1, 3).cast("int")),
        o=p["o"], a=F.lower(p["a"]), e=p["e"], es=F.when(p["e"] != "", F.ltrim(p["e"], F.lit("-")).try_cast("bigint")), ef=p["f"] != "",
    )
    d = step(
        d,
        m=F.coalesce(c("m"), c("w"), F.when(c("mf"), c("n1")).otherwise(c("n2"))),
        d=F.coalesce(c("d"), F.when(c("mf"), c("n2")).otherwise(c("n1"))),
        h=F.when(c("half") == "", c("h")).when(c("h").between(1, 12), c("h") % 12 + F.when(c("half") == "p", 12).otherwise(0)),
        oh=number(F.substring(c("od"), 1, 2)), om=F.coalesce(number(F.substring(c("od"), 3, 2)), F.lit(0)),
        in_utc=F.exists(F.array(c("a")), lambda x: x.isin(UTC_NAMES)),
        leap=((c("y") % 4 == 0) & (c("y") % 100 != 0)) | (c("y") % 400 == 0),
    )
    length = F.when(c("m") == 2, F.when(c("leap"), 29).otherwise(28)).when(c("m").isin(4, 6, 9, 11), 30).otherwise(31)
    # The year is counted from March, so that the leap day is its last.
    d = step(
        d,
        valid=c("y").between(1, 9999) & c("m").between(1, 12) & c("d").between(1, length) & c("h").between(0, 23) & c("mi").between(0, 59) & c("s").between(0, 59),
        my=(c("y") - F.when(c("m") <= 2, 1).otherwise(0)).cast("bigint"), mm=(c("m") + 9) % 12,
        offset=F.when((c("oh") <= 18) & (c("om") <= 59), F.when(F.startswith(c("o"), F.lit("-")), -1).otherwise(1) * (c("oh") * 60 + c("om"))).cast("bigint"),
    )
    # Days since 1970 of a proleptic Gregorian date.
    days = c("my") * 365 + whole(c("my"), 4) - whole(c("my"), 100) + whole(c("my"), 400) + whole(c("mm") * 306 + 5, 10) + c("d") - 1 - 719468
    d = step(d, wall=F.when(c("valid"), days * 86_400_000 + (c("h") * 3_600_000 + c("mi") * 60_000 + c("s") * 1000 + c("f")).cast("bigint")))
    # A filter on ``out`` must not be pushed through the steps: it would copy each of them into the filter.
    # The optimiser pushes nothing through a projection that holds a running number.
    d = step(d, row=F.monotonically_increasing_id(), early=F.when((c("o") == "") & ~c("in_utc"), F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(c("wall")), F.col(zone)))))
    twice = F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(c("early") + 3_600_000), F.col(zone))) == c("wall")
    local = F.when(c("a").isin(STANDARD_NAMES) & twice, c("early") + 3_600_000).otherwise(c("early"))
    known = (c("a") == "") | c("a").isin(*FORWARD_NAMES, *STANDARD_NAMES)
    dated = F.when(c("o") != "", c("wall") - c("offset") * 60_000).when(c("in_utc"), c("wall")).when(known, local)
    # Counts of seconds, or of milli-, micro- or nanoseconds, by their size; what doesn't fit 64 bits is none.
    size, sign = c("es"), F.when(F.startswith(c("e"), F.lit("-")), -1).otherwise(1)
    whole_ms = F.when(size < 10**11, size * 1000 + c("f").cast("bigint")).when(c("ef"), None).when(size < 10**14, size)
    whole_ms = whole_ms.when(size < 10**17, F.expr("_i_es div 1000")).otherwise(F.expr("_i_es div 1000000"))
    counted = whole_ms * sign
    return d.select(*df.columns, F.when((F.size(parts) > 1) & (c("row") >= 0), F.when(c("e") != "", counted).otherwise(dated)).alias(out))


def to_utc_millis(df: DataFrame, text: str, zone: str, order: str, out: str) -> DataFrame:
    """Add ``out`` for a text column; see ``parts_to_utc_millis``."""
    d = parts_to_utc_millis(df.withColumn("_i_parts", instant_parts(F.col(text))), "_i_parts", zone, order, out)
    return d.drop("_i_parts")
