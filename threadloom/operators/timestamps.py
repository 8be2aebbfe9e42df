"""Timestamps in mixed layouts, precisions and zones, brought to microseconds since 1970 UTC.

Every value is parsed under each layout it is valid in, with Spark's own expressions. Most values fit one layout (zone
abbreviations and the unit of bare numbers are fixed by rule and leave no choice). Those that fit several (03/04/2021,
03042021) are settled by expectation-maximisation over a mixture of layouts for each source: a
value adds likelihood under each of its valid parses, the mixture weights are re-estimated from the posteriors, and
the posterior picks the reading. Where no reading is likely enough the value is marked as ambiguous.

The mixture needs only how often each set of valid layouts occurs in each source; that table is bounded by
sources x sets and is the one thing that reaches the driver.
"""

from __future__ import annotations

from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 330, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240, "SAST": 120, "HKT": 480, "SGT": 480, "JST": 540, "KST": 540, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: The layout that mail headers should have.
HEADER_LAYOUT = (
    r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4} \d\d:\d\d:\d\d [+-]\d{4}\z"
)


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")


def _year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(F.length(text) > 2, y).when(y < 70, y + 2000).otherwise(y + 1900)


#: Two numbers and a year in an order that the text does not tell.
NUMBERS = r"(?<![\d:])(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?![\d:])"
#: A day of eight digits, of which the order is not told either.
EIGHT = r"^ *\d{8} *$"
CLOCK = r"(?<![\d:])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?![\d:])"
COMPACT = r"(?<!\d)(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?(?!\d)"
DAY_MONTH = r"(?<!\d)(\d{1,2})(?:st|nd|rd|th)?[ \-]((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))[A-Za-z]*\.?,?[ \-](\d{4}|\d{2})(?![\d:])"
MONTH_DAY = (
    r"(?<![A-Za-z])((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))[a-z]*\.? (\d{1,2})(?:st|nd|rd|th)?,?"
    r"(?: \d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?(?: [A-Za-z]{1,5}(?:[+-]\d{2}:?\d{2})?)? (\d{4})(?![\d:])"
)
YEAR_FIRST = r"(?<!\d)(\d{4})[-/.年] ?(\d{1,2})[-/.月] ?(\d{1,2})(?!\d)"
OFFSET = r"([+\-\x{2212}])(\d{2}):?(\d{2})(?!\d)"
REGION = r"[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+"


def tidy(value: Column) -> Column:
    """A text with runs of white space as one blank, nothing around it and no header name before it."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"(?U)[\s\x{feff}]+", " "), r"(?i)^ ?date ?: ?", ""))


def parse(df: DataFrame, value: str) -> DataFrame:
    """df with _parses, an array of struct(layout, utc_us): every valid reading of a text column.

    Null, blank, '-', words and impossible dates give an empty array. The columns are built in steps, each of which
    runs a pattern once; later steps use its groups.
    """
    groups = lambda pattern, *ks: F.split(F.regexp_replace(F.regexp_extract("_text", pattern, 0), pattern, "|".join(f"${k}" for k in ks)), r"\|")
    item = lambda c, k: F.get(c, k).try_cast("int")
    text = F.col("_text")
    df = df.withColumn("_text", tidy(F.col(value)))
    bare = text.rlike(r"^[+-]?\d{1,17}(?:\.\d+)?$") & ~text.rlike(r"^\d{8}$|^\d{4}$")
    kind = (
        F.when(bare, "bare")
        .when(text.rlike(r"^\d{8}(?:[Tt ]?\d{4}(?:\d{2})?(?!\d)|$)"), "compact")
        .when(text.rlike(DAY_MONTH), "day_month")
        .when(text.rlike(MONTH_DAY), "month_day")
        .when(text.rlike(YEAR_FIRST), "year_first")
        .when(text.rlike(NUMBERS), "numbers")
    )
    df = df.withColumn("_kind", kind)
    k = F.col("_kind")
    day = (
        F.when(k == "compact", F.array(F.substring("_text", 1, 4), F.substring("_text", 5, 2), F.substring("_text", 7, 2)))
        .when(k == "day_month", groups(DAY_MONTH, 3, 2, 1))
        .when(k == "month_day", groups(MONTH_DAY, 3, 1, 2))
        .when(k == "year_first", groups(YEAR_FIRST, 1, 2, 3))
        .when(k == "numbers", groups(NUMBERS, 1, 2, 3))
    )
    clock = F.when(k == "compact", groups(COMPACT, 4, 5, 6, 7)).when(k != "bare", groups(CLOCK, 1, 2, 3, 4))
    df = df.withColumns({"_day": day, "_clock": clock})
    after = F.when(k == "compact", F.regexp_replace(text, r"^\d{8}[Tt ]?\d{0,6}(?:[.,]\d+)?", "")).when(
        F.get("_clock", 0) != "", F.regexp_replace(text, r"^.*?(?<![\d:])\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?![\d:])", "")
    )
    noon = F.when(text.rlike(r"(?i)\d ?[ap]\.?m\b|上午|下午"), F.lower(F.regexp_extract(text, r"(?i)(?<![a-z])([ap])\.?m\b|(上午|下午)", 0)))
    df = df.withColumns({"_after": after, "_noon": noon})
    known = "|".join(sorted(ABBREVIATIONS, key=lambda x: -len(x)))
    zone = F.when(F.col("_after").rlike(OFFSET), F.regexp_replace(F.regexp_extract("_after", OFFSET, 0), OFFSET, "$1|$2|$3")).when(F.col("_after").rlike("[A-Za-z]"), F.regexp_extract("_after", REGION, 0))
    short = F.when(~F.col("_after").rlike(OFFSET) & F.col("_after").rlike("[A-Za-z]"), F.upper(F.regexp_extract("_after", rf"(?i)(?<![a-z/])({known})(?![a-z/])", 1)))
    df = df.withColumns({"_zone": zone, "_short": short})
    parts = F.split("_zone", r"\|")
    numeric = F.when(F.size(parts) == 3, F.when(F.get(parts, 0) == "+", 1).otherwise(-1) * (item(parts, 1) * 60 + item(parts, 2)))
    fixed = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    regions = sorted(z for z in available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "SystemV/")))
    names = F.map_from_arrays(F.array(*[F.lit(z.lower()) for z in regions]), F.array(*map(F.lit, regions)))
    region = F.when(F.col("_zone").rlike("^[A-Za-z]"), F.try_element_at(names, F.lower("_zone")))
    h = F.coalesce(item("_clock", 0), F.lit(0))
    pm, am = F.col("_noon").rlike("^p|下午"), F.col("_noon").rlike("^a|上午")
    df = df.withColumns(
        {
            "_offset": F.coalesce(numeric, F.try_element_at(fixed, F.when(F.col("_short") != "", F.col("_short")))),
            "_region": region,
            "_hour": F.when(pm & (h < 12), h + 12).when(am & (h == 12), 0).otherwise(h),
            "_minute": F.coalesce(item("_clock", 1), F.lit(0)),
            "_second": F.coalesce(item("_clock", 2), F.lit(0)),
            "_micros": F.coalesce(F.substring(F.rpad(F.get("_clock", 3), 6, "0"), 1, 6).try_cast("int"), F.lit(0)),
            "_number": F.when(k == "bare", text).try_cast("decimal(38,9)"),
        }
    )

    def instant(y: Column, m: Column, d: Column) -> Column:
        local = F.try_make_timestamp(y, m, d, F.col("_hour"), F.col("_minute"), F.col("_second").cast("decimal(8,6)"), F.lit("UTC"))
        us = F.when(F.col("_offset").isNotNull(), F.unix_micros(local) - F.col("_offset").cast("long") * 60_000_000)
        # a repeated local time is read as the earlier instant, a skipped one with the offset before the change
        us = us.when(F.col("_region").isNotNull(), F.unix_micros(F.to_utc_timestamp(local, F.col("_region")))).otherwise(F.unix_micros(local))
        return us + F.col("_micros")

    read = lambda layout, us: F.struct(F.lit(layout).alias("layout"), us.cast("long").alias("utc_us"))
    year = lambda c: F.when(F.length(c) > 2, c.try_cast("int")).when(c.try_cast("int") < 70, c.try_cast("int") + 2000).otherwise(c.try_cast("int") + 1900)
    one, two, three = (F.get("_day", x) for x in range(3))
    number, size = F.col("_number"), F.abs("_number")
    digits = lambda at, n: F.substring("_text", at, n).try_cast("int")
    eight = text.rlike(EIGHT) & digits(5, 4).between(1970, 2099)  # the year may stand last
    epoch = F.when(size < 100_000_000_000, read("epoch_s", F.floor(number * 1_000_000))).when(size < 100_000_000_000_000, read("epoch_ms", F.floor(number * 1000))).otherwise(read("epoch_us", F.floor(number)))
    parses = (
        F.when(k == "bare", F.array(epoch))
        .when(
            k == "compact",
            F.array(
                read("compact", instant(item("_day", 0), item("_day", 1), item("_day", 2))),
                F.when(eight, read("compact_day_first", instant(digits(5, 4), digits(3, 2), digits(1, 2)))),
                F.when(eight, read("compact_month_first", instant(digits(5, 4), digits(1, 2), digits(3, 2)))),
            ),
        )
        .when(k == "year_first", F.array(read("year_first", instant(item("_day", 0), item("_day", 1), item("_day", 2)))))
        .when(k.isin("day_month", "month_day"), F.array(read("named_month", instant(year(one), _month(two), item("_day", 2)))))
        .when(
            k == "numbers",
            F.array(
                read("day_first", instant(year(three), item("_day", 1), item("_day", 0))),
                read("month_first", instant(year(three), item("_day", 0), item("_day", 1))),
                F.when(F.length(three) == 2, read("short_year_first", instant(year(one), item("_day", 1), item("_day", 2)))),
            ),
        )
    )
    valid = F.coalesce(F.filter(parses, lambda p: p.isNotNull() & p["utc_us"].isNotNull()), F.array().cast("array<struct<layout:string,utc_us:bigint>>"))
    # a generator, so that a later filter on the readings isn't evaluated twice by being pushed below them
    out = df.select("*", F.inline(F.array(F.struct(valid.alias("_parses")))))
    return out.drop("_text", "_kind", "_day", "_clock", "_after", "_noon", "_zone", "_short", "_offset", "_region", "_hour", "_minute", "_second", "_micros", "_number")


def mixture(counts: list[tuple[str, tuple[str, ...], int]], rounds: int = 50, smooth: float = 0.5) -> dict[tuple[str, str], float]:
    """EM over (source, set of valid layouts, values): the weight of each layout in each source."""
    sources: dict[str, list[tuple[tuple[str, ...], int]]] = {}
    for source, layouts, n in counts:
        if layouts:
            sources.setdefault(source, []).append((layouts, n))
    weights = {}
    for source, sets in sources.items():
        names = sorted({x for layouts, _ in sets for x in layouts})
        w = dict.fromkeys(names, 1 / len(names))
        for _ in range(rounds):
            new = dict.fromkeys(names, smooth)
            for layouts, n in sets:
                total = sum(w[x] for x in layouts)
                for x in layouts:
                    new[x] += n * w[x] / total
            total = sum(new.values())
            change = max(abs(new[x] / total - w[x]) for x in names)
            w = {x: new[x] / total for x in names}
            if change < 1e-9:
                break
        weights |= {(source, x): v for x, v in w.items()}
    return weights


def normalise(df: DataFrame, value: str, source: Column, sure: float = 0.9) -> DataFrame:
    """df with utc_us, layout, posterior and state (`sure`, `ambiguous`, `none`) of the text column.

    source: what shares one mixture of layouts. utc_us is null unless the state is `sure`: a reading whose posterior
    is below `sure` is not chosen, the likeliest one then stands in guess_us.
    Nulls, blanks and texts that denote no instant have the state `none`; repeated rows stay; extra columns are kept,
    but for ones of the names that are added, which are replaced. An empty table gives an empty one.
    """
    added = ["utc_us", "guess_us", "layout", "posterior", "state"]
    df = df.drop(*[c for c in df.columns if c in added])
    df = df.withColumn("_source", F.coalesce(source.cast("string"), F.lit("")))
    # posteriors of the other layouts are 1; only these take part in a mixture
    open_ = parse(df.where(F.col(value).rlike(NUMBERS) | F.col(value).rlike(EIGHT)).select("_source", value), value)
    rows = open_.groupBy("_source", F.transform("_parses", lambda p: p["layout"]).alias("layouts")).count().collect()
    weights = mixture([(r["_source"], tuple(dict.fromkeys(r["layouts"])), r["count"]) for r in rows])
    read = parse(df, value)
    if weights:
        table = F.create_map(*[F.lit(x) for (s, layout), w in weights.items() for x in (f"{s}\0{layout}", w)])
        weight = lambda p: F.coalesce(F.try_element_at(table, F.concat_ws("\0", F.col("_source"), p["layout"])), F.lit(0.0))
    else:
        weight = lambda p: F.lit(1.0)
    # readings of the same instant are one interpretation
    scored = F.transform("_parses", lambda p: F.struct(weight(p).alias("w"), (-p["utc_us"]).alias("order"), p["utc_us"].alias("us"), p["layout"].alias("layout")))
    best = F.array_max("_scored")
    total = F.aggregate("_scored", F.lit(0.0), lambda a, s: a + s["w"])
    same = F.aggregate("_scored", F.lit(0.0), lambda a, s: a + F.when(s["us"] == F.col("_best.us"), s["w"]).otherwise(0.0))
    out = read.withColumn("_scored", scored).withColumn("_best", best)
    out = out.withColumn("posterior", F.when(F.size("_parses") == 1, 1.0).otherwise(F.try_divide(same, total)))
    state = F.when(F.size("_parses") == 0, "none").when(F.col("posterior") >= sure, "sure").otherwise("ambiguous")
    return out.withColumns({"state": state, "layout": F.col("_best.layout"), "guess_us": F.col("_best.us"), "utc_us": F.when(state == "sure", F.col("_best.us"))}).drop(
        "_source", "_parses", "_scored", "_best"
    )


def dated_fields(emails: DataFrame, threads: DataFrame) -> DataFrame:
    """(rec_table, rec_key, rec_field, value) of the three text fields that hold dates, one row for each non-null value."""
    rows = [(emails, "emails", "date"), (threads, "threads", "start_date"), (threads, "threads", "end_date")]
    return reduce(
        DataFrame.unionByName,
        [t.select(F.lit(name).alias("rec_table"), F.col("id").cast("string").alias("rec_key"), F.lit(field).alias("rec_field"), F.col(field).cast("string").alias("value")).where(F.col("value").isNotNull()) for t, name, field in rows],
    )


def odd_instants(emails: DataFrame, threads: DataFrame) -> DataFrame:
    """The instants of all values that are not in the layout of mail headers."""
    known = normalise(dated_fields(emails, threads), "value", F.concat_ws(".", "rec_table", "rec_field"))
    return known.where((F.col("state") == "sure") & ~F.col("value").rlike(HEADER_LAYOUT)).select("rec_table", "rec_key", "rec_field", "utc_us")
