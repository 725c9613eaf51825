"""Problem 3: printed times in mixed formats and zones to one instant in UTC.

Everything is a Spark SQL expression: the text is cleaned, matched against a few date forms, rewritten into one
delimited record and split once, so no Python runs per row. A missing zone is estimated from the history of offsets
that the owner's other rows show and from the ingestion time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipweave.operators.skew import lookup

# Month names as printed, by month.
MONTHS = {
    1: ["jan", "january", "januar", "มค", "มกราคม"],
    2: ["feb", "february", "februar", "กพ", "กุมภาพันธ์"],
    3: ["mar", "march", "mär", "märz", "mrz", "maerz", "มีค", "มีนาคม"],
    4: ["apr", "april", "เมย", "เมษายน"],
    5: ["may", "mai", "พค", "พฤษภาคม"],
    6: ["jun", "june", "juni", "มิย", "มิถุนายน"],
    7: ["jul", "july", "juli", "กค", "กรกฎาคม"],
    8: ["aug", "august", "สค", "สิงหาคม"],
    9: ["sep", "sept", "september", "กย", "กันยายน"],
    10: ["oct", "october", "okt", "oktober", "ตค", "ตุลาคม"],
    11: ["nov", "november", "พย", "พฤศจิกายน"],
    12: ["dec", "december", "dez", "dezember", "ธค", "ธันวาคม"],
}
# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "gst": 240, "pkt": 300, "ist": 330, "npt": 345, "mmt": 390, "ict": 420, "wib": 420,
    "sgt": 480, "hkt": 480, "myt": 480, "awst": 480, "wita": 480, "jst": 540, "kst": 540, "acst": 570, "acdt": 630,
    "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300,
    "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540,
    "akdt": -480, "hst": -600,
}
#: How far a slip may lie after its arrival before the clock or the zone counts as wrong.
TOLERANCE_US = 2 * 60 * 1_000_000
BUDDHIST_AHEAD = 543
#: Length of a step of an owner's history; evidence halves with each step between, and counts less under another locale.
STEP_US, OTHER_LOCALE = 7 * 24 * 3600 * 1_000_000, 0.25

_WIDE = "０１２３４５６７８９：／．－＋，（）"
_NARROW = "0123456789:/.-+,()"
_THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
_BLANKS = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
_UNSEEN = "[\\u00ad\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff]"
_THAI = "\\u0e01-\\u0e4e"

_SEP = "(?:\\s*,?\\s*t\\s*|\\s*[,;]?\\s*(?:-\\s*|at\\s+|um\\s+|เวลา\\s*)?)"
_CLOCK = "(\\d{1,2})[:.](\\d{2})(?:[:.](\\d{2})(?:[.,](\\d{1,9}))?)?(?:\\s*([ap])\\.?m\\b\\.?)?(?:\\s*(?:uhr|น\\.?))?"
_ZONE = "(?:\\s*\\(?\\s*((?:utc|gmt)?\\s*[-+]\\s*\\d{1,2}(?::?\\d{2})?|[a-z]{1,5})\\s*\\)?)?"
_WORD = f"([a-zä]{{3,9}}|[{_THAI}][{_THAI}.]*[{_THAI}])"
_DAYNAME = "(?:[a-z]{2,9}\\.?,\\s*)?"
_TAIL = _SEP + _CLOCK + _ZONE + "$"
#: (pattern, order of year, month, day groups; None: by locale). Groups 4 to 9 are hour, minute, second, fraction, a/p, zone.
_FORMS = [
    ("^(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})" + _TAIL, "ymd"),
    ("^(\\d{4})\\s*年\\s*(\\d{1,2})\\s*月\\s*(\\d{1,2})\\s*日" + _TAIL, "ymd"),
    ("^(\\d{1,2})[-/.](\\d{1,2})[-/.](\\d{4}|\\d{2})" + _TAIL, None),
    (f"^{_DAYNAME}(\\d{{1,2}})\\.?[\\s-]*{_WORD}\\.?,?[\\s-]*(\\d{{4}}|\\d{{2}})" + _TAIL, "dmy"),
    (f"^{_DAYNAME}{_WORD}\\.?\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})" + _TAIL, "mdy"),
    ("^(\\d{4})(\\d{2})(\\d{2})[t ]?(\\d{2}):?(\\d{2})(?::?(\\d{2})(?:[.,](\\d{1,9}))?)?()" + _ZONE + "$", "ymd"),
]


def clean_time_text(value: Column) -> Column:
    """Lower case, one blank width, ASCII digits, no characters without width, no blanks around Thai dots."""
    c = F.translate(value, _WIDE + _THAI_DIGITS + "−–", _NARROW + "0123456789" + "--")
    c = F.regexp_replace(F.regexp_replace(c, _UNSEEN, ""), _BLANKS, " ")
    c = F.lower(F.trim(c))
    return F.regexp_replace(c, f"(?<=[{_THAI}])\\s*\\.(?:\\s*(?=[{_THAI}]))?", ".")


def _record(text: Column, locale: Column) -> Column:
    """y|m|d|h|mi|s|fraction|ap|zone, or null where no form fits."""
    out = None
    for pattern, order in _FORMS:
        for when, o in ([(None, order)] if order else [
            (locale.startswith("en-US"), "mdy"), (locale.startswith("ja") | locale.startswith("zh") | locale.startswith("ko"), "ymd"), (None, "dmy"),
        ]):
            at = {k: f"${o.index(k) + 1}" for k in "ymd"}
            rewritten = F.regexp_replace(text, pattern, "|".join([at["y"], at["m"], at["d"], *(f"${g}" for g in range(4, 10))]))
            hit = text.rlike(pattern) if when is None else (F.coalesce(when, F.lit(False)) & text.rlike(pattern))
            out = F.when(hit, rewritten) if out is None else out.when(hit, rewritten)
    return out


def _month(word: Column) -> Column:
    named = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for n in names for x in (n, m)])
    return F.coalesce(F.expr("try_cast(NULL as int)"), word.try_cast("int"), named[F.regexp_replace(word, "\\.", "")])


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of a printed zone; null for none or an unknown one."""
    known = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours = F.when(F.length(digits) <= 2, digits).otherwise(F.substring(digits, 1, 20).substr(F.lit(1), F.length(digits) - 2)).try_cast("int")
    minutes = F.when(F.length(digits) <= 2, F.lit(0)).otherwise(F.right(digits, F.lit(2)).try_cast("int"))
    numeric = F.when((hours <= 15) & (minutes < 60), (hours * 60 + minutes) * F.when(zone.contains("-"), -1).otherwise(1))
    return F.when(zone.rlike("[-+]"), numeric).otherwise(known[zone])


def parse_printed_time(df: DataFrame, value: Column, locale: Column, prefix: str = "_t_") -> DataFrame:
    """Add {prefix}local_us (wall clock as if UTC), {prefix}epoch_us, {prefix}has_zone and {prefix}offset_min.

    Null, empty, unreadable or impossible values give null in all of them. A date without a time of day, or a time
    without a date, is not readable. Two-digit years of 60 or more and four-digit years of 2400 or more are Thai.
    """
    p = lambda n: F.col(prefix + n)
    df = df.withColumn(prefix + "text", clean_time_text(value))
    digits = F.regexp_extract(p("text"), "^(\\d{10})(?:[.,](\\d{1,6})\\d{0,3})?$|^(\\d{13})$|^(\\d{16})$", 0)
    whole = p("text")
    epoch = (
        F.when(digits == "", None)
        .when(F.length(whole) == 13, F.when(~whole.contains("."), whole.try_cast("long") * 1000))
        .when(F.length(whole) == 16, F.when(~whole.contains("."), whole.try_cast("long")))
    )
    seconds = F.substring(whole, 1, 10).try_cast("long") * 1_000_000
    fraction = F.rpad(F.substring(whole, 12, 6), 6, "0").try_cast("long")
    epoch = F.coalesce(epoch, F.when(whole.rlike("^\\d{10}$"), seconds).when(whole.rlike("^\\d{10}[.,]\\d{1,9}$"), seconds + fraction))
    df = df.withColumn(prefix + "epoch_us", epoch)
    df = df.withColumn(prefix + "rec", F.when(p("epoch_us").isNull(), F.split(_record(p("text"), locale), "\\|")))
    part = lambda i: F.nullif(p("rec")[i], F.lit(""))
    year = part(0).try_cast("int")
    year = F.when(F.length(part(0)) == 2, F.when(year >= 60, year + 2500 - BUDDHIST_AHEAD).otherwise(year + 2000)).when(year >= 2400, year - BUDDHIST_AHEAD).otherwise(year)
    hour = part(3).try_cast("int")
    hour = F.when(part(7).isNull(), F.when(hour <= 23, hour)).when(hour.between(1, 12), hour % 12 + F.when(part(7) == "p", 12).otherwise(0))
    second = F.coalesce(part(5), F.lit("0")).try_cast("int")
    minute = part(4).try_cast("int")
    micros = F.coalesce(F.rpad(F.substring(part(6), 1, 6), 6, "0"), F.lit("0")).try_cast("long")
    day = F.unix_micros(F.try_make_timestamp(year, _month(part(1)), part(2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    local = F.when((second < 60) & (minute < 60), day + ((hour * 60 + minute) * 60 + second).cast("long") * 1_000_000 + micros)
    df = df.withColumn(prefix + "local_us", local)
    df = df.withColumn(prefix + "has_zone", p("local_us").isNotNull() & part(8).isNotNull())
    df = df.withColumn(prefix + "offset_min", F.when(p("has_zone"), _offset_minutes(F.regexp_replace(part(8), "\\s", ""))))
    return df.drop(prefix + "rec", prefix + "text")


def known_zones(spark: SparkSession) -> set[str]:
    """Zone ids the JVM can resolve; any other text is treated as no zone."""
    return set(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()) if hasattr(spark, "sparkContext") else {"UTC"}


def in_zone(local_us: Column, zone: Column) -> Column:
    """Instant of a wall clock time: a doubled one is the first, a skipped one uses the offset before the change."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


def _history(rows: DataFrame) -> DataFrame:
    """(o, zones): per owner in need its candidate zones, each with the steps of time in which rows agree with it.

    Rows are counted by step, locale, zone and offset before the shuffle, so an owner of very many rows is no hot task;
    a history is as long as the owner's time and locales, not as its rows.
    """
    shown = rows.groupBy("o", "l", "step", "z", "off").agg(F.count("*").alias("n"), F.max("local").alias("at"))
    zones = rows.where(F.col("z").isNotNull()).select("o", F.col("z").alias("zone")).distinct()
    agrees = F.when(F.col("z").isNotNull(), F.col("z") == F.col("zone")).otherwise(in_zone(F.col("at"), F.col("zone")) == F.col("at") - F.col("off") * 60_000_000)
    met = shown.join(zones, "o").groupBy("o", "zone", "l", "step").agg(F.sum(F.when(agrees, F.col("n")).otherwise(0)).alias("n")).where("n > 0")
    each = met.groupBy("o", "zone").agg(F.collect_list(F.struct("step", "l", "n")).alias("steps"))
    return each.groupBy("o").agg(F.collect_list(F.struct("zone", "steps")).alias("zones"))


def estimate_zones(df: DataFrame) -> DataFrame:
    """(k, est_zone) of every row without zone: the zone whose history of offsets the row and its neighbours violate least.

    df has k, o (owner), l (locale), a (arrival), local and, where known, instant and z (zone by name). A zone that puts
    the row after its arrival comes last; else the one with which most of the owner's rows agree, near in time and of the
    same locale first; then the one nearest before arrival. Owners without any known zone take those of the locale, else of any. Work
    is in proportion to the rows in need times the zones of their own owner.
    """
    df = df.withColumn("step", F.floor(F.coalesce("a", "local") / STEP_US).cast("int"))
    need = df.where(F.col("instant").isNull() & F.col("local").isNotNull()).select("k", "o", "l", "a", "local", "step")
    owners = need.where(F.col("o").isNotNull()).select("o").distinct()
    known = df.where(F.col("instant").isNotNull() & F.col("local").isNotNull()).select("o", "l", "step", "z", ((F.col("local") - F.col("instant")) / 60_000_000).cast("long").alias("off"), "local")
    with_owner = lookup(need, _history(known.join(owners, "o", "left_semi")), ["o"])
    # What owners without a known zone may take: the zones of their locale, else of any; each at most those that exist.
    used = known.where(F.col("z").isNotNull()).groupBy("l", "z").agg(F.count("*").alias("n"))
    zones = F.collect_list(F.struct(F.col("z").alias("zone"), F.array(F.struct(F.lit(0).alias("step"), "l", "n")).alias("steps")))
    of_locale = used.groupBy("l").agg(zones.alias("common"))
    of_any = used.groupBy("z").agg(F.sum("n").alias("n")).withColumn("l", F.lit("")).agg(zones.alias("any")).withColumn("_one", F.lit(1))
    both = with_owner.join(of_locale, "l", "left").withColumn("_one", F.lit(1)).join(F.broadcast(of_any), "_one", "left")

    def judged(z: Column) -> Column:
        guess = in_zone(F.col("local"), z["zone"])
        late = F.coalesce(guess > F.col("a") + TOLERANCE_US, F.lit(False))
        near = lambda s: s["n"] * F.pow(F.lit(0.5), F.least(F.abs(s["step"] - F.col("step")), F.lit(12))) * F.when(s["l"].eqNullSafe(F.col("l")), 1.0).otherwise(OTHER_LOCALE)
        weight = F.aggregate(z["steps"], F.lit(0.0), lambda acc, s: acc + near(s))
        return F.struct(late.alias("late"), (-weight).alias("against"), F.when(late, guess - F.col("a")).otherwise(F.col("a") - guess).alias("lag"), z["zone"].alias("zone"))

    best = F.array_min(F.transform(F.coalesce("zones", "common", "any"), judged))
    return both.select("k", best["zone"].alias("est_zone"))


def normalise_times(df: DataFrame, key: str, owner: str, value: str, zone: str, locale: str, arrived: str) -> DataFrame:
    """One row per key with a readable value: key, instant_us, zone_from (EPOCH, VALUE, DEVICE, ESTIMATED), zone_used.

    Rows repeated with one key count once (the earliest arrival is kept). Null, empty and impossible values have no
    row. Without any zone it is estimated from the owner's other rows; with nothing to estimate from the instant is null.
    Columns of df beyond those named are ignored, so clashing names do no harm; an empty table gives no rows.
    """
    spark = df.sparkSession
    src = df.select(
        F.col(key).alias("_k"), F.col(owner).alias("_o"), F.col(value).alias("_v"), F.col(zone).alias("_z"), F.col(locale).alias("_l"),
        F.unix_micros(F.col(arrived)).alias("_a"),
    ).where(F.col("_v").isNotNull() & F.col("_k").isNotNull())
    src = parse_printed_time(src, F.col("_v"), F.coalesce(F.col("_l"), F.lit("")))
    valid = F.col("_z").isin(sorted(known_zones(spark)))
    printed = F.col("_t_offset_min").isNotNull()
    device = ~F.col("_t_has_zone") & valid
    src = src.withColumn(
        "_instant",
        F.when(F.col("_t_epoch_us").isNotNull(), F.col("_t_epoch_us"))
        .when(printed, F.col("_t_local_us") - F.col("_t_offset_min").cast("long") * 60_000_000)
        .when(device, in_zone(F.col("_t_local_us"), F.when(valid, F.col("_z")).otherwise("UTC"))),
    ).withColumn("_from", F.when(F.col("_t_epoch_us").isNotNull(), "EPOCH").when(printed, "VALUE").when(device, "DEVICE").when(~F.col("_t_has_zone"), "ESTIMATED"))
    # Filters on parsed columns come after the aggregate: pushed below it they would repeat the whole parse.
    first = src.groupBy("_k").agg(
        F.min(F.struct("_a", "_v", "_instant", "_from", "_t_local_us", "_z", "_l", "_o")).alias("r")
    ).select("_k", "r.*")
    first = first.where(F.coalesce("_instant", "_t_local_us").isNotNull() & F.col("_from").isNotNull())
    seen = first.where(F.col("_from") != "EPOCH").select(
        F.col("_k").alias("k"), F.col("_o").alias("o"), F.coalesce("_l", F.lit("")).alias("l"), F.col("_a").alias("a"), F.col("_t_local_us").alias("local"), F.col("_instant").alias("instant"),
        F.when(F.col("_from") == "DEVICE", F.col("_z")).alias("z"),
    )
    guessed = estimate_zones(seen)
    out = first.join(guessed.withColumnRenamed("k", "_k"), "_k", "left")
    est = F.when((F.col("_from") == "ESTIMATED") & F.col("est_zone").isNotNull(), in_zone(F.col("_t_local_us"), F.coalesce("est_zone", F.lit("UTC"))))
    return out.select(
        F.col("_k").alias(key),
        F.coalesce("_instant", est).alias("instant_us"),
        F.col("_from").alias("zone_from"),
        F.when(F.col("_from") == "DEVICE", F.col("_z")).when(F.col("_from") == "ESTIMATED", F.col("est_zone")).alias("zone_used"),
    )
