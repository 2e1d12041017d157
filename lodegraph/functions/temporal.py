"""Dates, times and durations.

Carriers: ``date`` is a Spark date, ``localdatetime`` a timestamp without zone; ``localtime``, ``time`` and
``datetime`` are structs of local microseconds (of the day, or since 1970), the offset in seconds and a
zone name; a duration is a struct of months, days and microseconds, which are never
normalised into each other.  At the edges of a query all of them are ISO-8601 text.
Precision is microseconds.  Functions without an argument give the epoch, as the language has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QuerySyntaxError
from ..operators import values as V
from ..operators.values import INT, STRING, Type, Value, null

DATE, LOCALDATETIME, LOCALTIME, TIME, DATETIME, DURATION = map(Type, ("date", "localdatetime", "localtime", "time", "datetime", "duration"))
KINDS = {t.name: t for t in (DATE, LOCALDATETIME, LOCALTIME, TIME, DATETIME)}
DAY = 86_400_000_000
#: Seconds of an average month, for fractions of months.
MONTH_SECONDS = 2_629_746
FUNCTIONS: dict[str, Callable[[list[Value]], Value]] = {}

EPOCH = "1970-01-01"


def _long(x) -> Column:
    return (F.lit(x) if not isinstance(x, Column) else x).cast("bigint")


def _div(a: Column, b: int) -> Column:
    """Floor division."""
    return F.call_function("div", a.cast("bigint") - F.pmod(a.cast("bigint"), _long(b)), _long(b))


def _trunc_div(a: Column, b: int) -> Column:
    return F.call_function("div", a.cast("bigint"), _long(b))


# -- parts


def days_of(d: Column) -> Column:
    return F.unix_date(d).cast("bigint")


def date_of(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def micros_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ntz_of(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def made_date(y: Column, m: Column, d: Column) -> Column:
    """A date from its parts, null where there is no such day."""
    return F.when(y.between(1, 9999), F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd"))


def week_date(y: Column, w: Column, day: Column) -> Column:
    fourth = F.make_date(y.cast("int"), F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    return F.when(w.between(1, 53), F.date_add(monday, ((w - 1) * 7 + day - 1).cast("int")))


def ordinal_date(y: Column, n: Column) -> Column:
    return F.date_add(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), (n - 1).cast("int"))


def quarter_date(y: Column, q: Column, n: Column) -> Column:
    return F.date_add(F.make_date(y.cast("int"), ((q - 1) * 3 + 1).cast("int"), F.lit(1)), (n - 1).cast("int"))


def packed(local: Column, offset: Column | None = None, zone: Column | None = None) -> Column:
    none = F.lit(None)
    out = F.struct(local.cast("bigint").alias("local"), (none if offset is None else offset).cast("int").alias("offset"), (none if zone is None else zone).cast("string").alias("zone"))
    return F.when(local.isNotNull(), out)


def local_micros(v: Value) -> Column:
    """Microseconds since 1970, or of the day for times."""
    if v.type == DATE:
        return days_of(v.col) * DAY
    if v.type == LOCALDATETIME:
        return micros_of(v.col)
    return v.col["local"]


def offset_of(v: Value) -> Column:
    return v.col["offset"] if v.type in (TIME, DATETIME) else F.lit(None).cast("int")


def zone_offset(local: Column, zone: Column) -> Column:
    """Seconds that ``zone`` (a name or an offset) is ahead of UTC at a local time."""
    ts = F.timestamp_micros(local)
    return _trunc_div(local - F.unix_micros(F.to_utc_timestamp(ts, zone)), 1_000_000).cast("int")


# -- reading text


def _int(s: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit("")).cast("bigint")


def parse_date(s: Column) -> Column:
    one = _long(1)
    ymd, week, ordinal, month, year = r"^(\d{4})-?(\d{2})-?(\d{2})$", r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", r"^(\d{4})-?(\d{3})$", r"^(\d{4})-(\d{2})$|^(\d{4})(\d{2})$", r"^(\d{4})$"
    return (
        F.when(s.rlike(ymd), made_date(_int(s, ymd, 1), _int(s, ymd, 2), _int(s, ymd, 3)))
        .when(s.rlike(week), week_date(_int(s, week, 1), _int(s, week, 2), F.coalesce(_int(s, week, 3), one)))
        .when(s.rlike(ordinal), ordinal_date(_int(s, ordinal, 1), _int(s, ordinal, 2)))
        .when(s.rlike(month), made_date(F.coalesce(_int(s, month, 1), _int(s, month, 3)), F.coalesce(_int(s, month, 2), _int(s, month, 4)), one))
        .when(s.rlike(year), made_date(_int(s, year, 1), one, one))
    )


_TIME = r"^(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?(?:Z|[+-]\d{2}(?::?\d{2}){0,2})?(?:\[[^\]]*\])?$"
_OFFSET = r"(Z|[+-]\d{2}(?::?\d{2}){0,2})(?:\[[^\]]*\])?$"


def parse_time(s: Column) -> Column:
    """Microseconds of the day."""
    part = lambda g: F.coalesce(_int(s, _TIME, g), _long(0))
    fraction = F.coalesce(F.when(F.regexp_extract(s, _TIME, 4) != "", F.substring(F.rpad(F.regexp_extract(s, _TIME, 4), 9, "0"), 1, 6).cast("bigint")), _long(0))
    total = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1_000_000 + fraction
    return F.when(s.rlike(_TIME) & (part(1) < 24) & (part(2) < 60) & (part(3) < 60), total)


def parse_offset(s: Column) -> Column:
    """Seconds of an offset at the end of a time; null without one."""
    found = F.regexp_extract(s, _OFFSET, 1)
    digits = F.rpad(F.regexp_replace(found, "[^0-9]", ""), 6, "0")
    seconds = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60 + F.substring(digits, 5, 2).try_cast("int")
    return F.when(found == "Z", F.lit(0)).when(found != "", F.when(F.startswith(found, F.lit("-")), -seconds).otherwise(seconds))


def parse_zone(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"\[([^\]]+)\]$", 1), F.lit(""))


def parsed(kind: Type, s: Column) -> Value:
    day, clock = F.regexp_extract(s, "^([^T]*)", 1), F.regexp_extract(s, "T(.*)$", 1)
    if kind == DATE:
        return Value(DATE, parse_date(day))
    if kind in (TIME, LOCALTIME):
        text = F.when(F.contains(s, F.lit("T")), clock).otherwise(s)
        at = parse_time(text)
        return Value(kind, packed(at, F.coalesce(parse_offset(text), F.lit(0)) if kind == TIME else None))
    at = days_of(parse_date(day)) * DAY + F.when(clock == "", _long(0)).otherwise(parse_time(clock))
    if kind == LOCALDATETIME:
        return Value(kind, ntz_of(at))
    zone = parse_zone(clock)
    offset = F.coalesce(parse_offset(clock), F.when(zone.isNotNull(), zone_offset(at, zone)), F.lit(0))
    return Value(DATETIME, packed(at, offset, zone))


# -- writing text


def _clock(micros: Column) -> Column:
    """``HH:MM``, with seconds and a fraction where they aren't zero."""
    seconds, rest = _div(micros, 1_000_000), F.pmod(micros, _long(1_000_000))
    hm = F.format_string("%02d:%02d", (_div(seconds, 3600)).cast("int"), F.pmod(_div(seconds, 60), _long(60)).cast("int"))
    s = F.format_string(":%02d", F.pmod(seconds, _long(60)).cast("int"))
    fraction = F.concat(F.lit("."), F.regexp_replace(F.format_string("%06d", rest.cast("int")), "0+$", ""))
    return F.concat(hm, F.when((rest == 0) & (F.pmod(seconds, _long(60)) == 0), F.lit("")).otherwise(F.concat(s, F.when(rest == 0, F.lit("")).otherwise(fraction))))


def _offset_text(offset: Column) -> Column:
    a = F.abs(offset)
    hm = F.format_string("%02d:%02d", F.floor(a / 3600).cast("int"), F.floor(F.pmod(a, F.lit(3600)) / 60).cast("int"))
    s = F.when(F.pmod(a, F.lit(60)) != 0, F.format_string(":%02d", F.pmod(a, F.lit(60)))).otherwise(F.lit(""))
    return F.when(offset == 0, F.lit("Z")).otherwise(F.concat(F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")), hm, s))


def _day_text(days: Column) -> Column:
    return date_of(days).cast("string")


def to_text(v: Value) -> Column:
    if v.type == DATE:
        return v.col.cast("string")
    if v.type == DURATION:
        return duration_text(v.col)
    at = local_micros(v)
    if v.type == LOCALTIME:
        return F.when(v.col.isNotNull(), _clock(at))
    if v.type == TIME:
        return F.when(v.col.isNotNull(), F.concat(_clock(at), _offset_text(v.col["offset"])))
    whole = F.concat(_day_text(_div(at, DAY)), F.lit("T"), _clock(F.pmod(at, _long(DAY))))
    if v.type == LOCALDATETIME:
        return F.when(v.col.isNotNull(), whole)
    zone = F.when(v.col["zone"].isNotNull(), F.concat(F.lit("["), v.col["zone"], F.lit("]"))).otherwise(F.lit(""))
    return F.when(v.col.isNotNull(), F.concat(whole, _offset_text(v.col["offset"]), zone))


def duration_text(c: Column) -> Column:
    months, days, micros = c["months"], c["days"], c["micros"]

    def part(n: Column, mark: str) -> Column:
        return F.when(n == 0, F.lit("")).otherwise(F.concat(n.cast("string"), F.lit(mark)))

    seconds, rest = _trunc_div(micros, 1_000_000), F.try_mod(micros, _long(1_000_000))
    second = F.try_mod(seconds, _long(60))
    sign = F.when((rest < 0) & (second == 0), F.lit("-")).otherwise(F.lit(""))
    fraction = F.concat(F.lit("."), F.regexp_replace(F.format_string("%06d", F.abs(rest).cast("int")), "0+$", ""))
    second_text = F.when((second == 0) & (rest == 0), F.lit("")).otherwise(F.concat(sign, second.cast("string"), F.when(rest == 0, F.lit("")).otherwise(fraction), F.lit("S")))
    clock = F.concat(part(_trunc_div(seconds, 3600), "H"), part(F.try_mod(_trunc_div(seconds, 60), _long(60)), "M"), second_text)
    text = F.concat(part(_trunc_div(months, 12), "Y"), part(F.try_mod(months, _long(12)), "M"), part(days, "D"), F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("T"), clock)))
    return F.when(c.isNotNull(), F.concat(F.lit("P"), F.when(text == "", F.lit("T0S")).otherwise(text)))


# -- construction


def _fields(v: Value) -> dict[str, Value]:
    return {k: Value(t, v.col.getField(k)) for k, t in v.type.fields}


def _base(fields: dict[str, Value], *keys: str) -> Value | None:
    for k in keys:
        if k in fields:
            v = fields[k]
            if v.type == STRING:
                v = parsed(DATE if k == "date" else LOCALTIME if k == "time" else DATETIME, v.col)
            return v if v.type.name in KINDS else None
    return None


def _date_part(fields: dict[str, Value]) -> Column | None:
    """Days since 1970 from a map; None without a date."""
    base = _base(fields, "date", "datetime")
    day0 = None if base is None or base.type in (TIME, LOCALTIME) else _div(local_micros(base), DAY)
    if "year" not in fields and day0 is None:
        return None
    d0 = date_of(day0) if day0 is not None else None
    get = lambda k, other: fields[k].col.cast("bigint") if k in fields else _long(other)
    year = get("year", F.year(d0) if d0 is not None else 1970)
    if "week" in fields:
        wyear = fields["year"].col.cast("bigint") if "year" in fields else F.extract(F.lit("YEAROFWEEK"), d0).cast("bigint")
        return days_of(week_date(wyear, get("week", 1), get("dayOfWeek", F.weekday(d0) + 1 if d0 is not None else 1)))
    if "ordinalDay" in fields:
        return days_of(ordinal_date(year, get("ordinalDay", 1)))
    if "quarter" in fields:
        day = F.datediff(d0, F.trunc(d0, "quarter")) + 1 if d0 is not None else 1
        return days_of(quarter_date(year, get("quarter", 1), get("dayOfQuarter", day)))
    return days_of(made_date(year, get("month", F.month(d0) if d0 is not None else 1), get("day", F.dayofmonth(d0) if d0 is not None else 1)))


_SUBSECOND = ("millisecond", "microsecond", "nanosecond")


def _time_part(fields: dict[str, Value]) -> Column:
    """Microseconds of the day from a map."""
    base = _base(fields, "time", "datetime")
    at0 = _long(0) if base is None or base.type == DATE else F.pmod(local_micros(base), _long(DAY))
    get = lambda k, other: fields[k].col.cast("bigint") if k in fields else other
    seconds = _div(at0, 1_000_000)
    h, m, s = get("hour", _div(seconds, 3600)), get("minute", F.pmod(_div(seconds, 60), _long(60))), get("second", F.pmod(seconds, _long(60)))
    rest = F.pmod(at0, _long(1_000_000))
    if any(k in fields for k in _SUBSECOND):
        zero = _long(0)
        rest = get("millisecond", zero) * 1000 + get("microsecond", zero) + _div(get("nanosecond", zero), 1000)
    return ((h * 60 + m) * 60 + s) * 1_000_000 + rest


def from_map(kind: Type, v: Value) -> Value:
    fields = _fields(v)
    day = _date_part(fields)
    if kind == DATE:
        return Value(DATE, date_of(day)) if day is not None else null(DATE)
    at = _time_part(fields)
    if kind == LOCALTIME:
        return Value(kind, packed(at))
    if kind in (LOCALDATETIME, DATETIME):
        if day is None:
            return null(kind)
        at = day * DAY + at
        if kind == LOCALDATETIME:
            return Value(kind, ntz_of(at))
    base = _base(fields, "datetime", "time")
    old = offset_of(base) if base is not None else F.lit(None).cast("int")
    if "timezone" in fields:
        zone = fields["timezone"].col
        fixed = parse_offset(zone)
        moment = at if kind == DATETIME else at  # a time takes a named zone's offset of 1970
        new = F.coalesce(fixed, zone_offset(moment, zone))
        at = F.when(old.isNotNull(), at + (new - old).cast("bigint") * 1_000_000).otherwise(at)
        at = F.pmod(at, _long(DAY)) if kind == TIME else at
        return Value(kind, packed(at, new, F.when(fixed.isNull(), zone) if kind == DATETIME else None))
    return Value(kind, packed(at, F.coalesce(old, F.lit(0))))


def converted(kind: Type, v: Value) -> Value:
    """A temporal value as another kind; missing parts are those of 1970-01-01T00:00Z."""
    if v.type == kind:
        return v
    at = local_micros(v)
    timed = v.type in (TIME, LOCALTIME)
    if kind == DATE:
        return null(DATE) if timed else Value(DATE, date_of(_div(at, DAY)))
    if kind in (TIME, LOCALTIME):
        clock = F.pmod(at, _long(DAY))
        return Value(kind, packed(clock, F.coalesce(offset_of(v), F.lit(0)) if kind == TIME else None))
    if timed:
        return null(kind)
    return Value(kind, ntz_of(at)) if kind == LOCALDATETIME else Value(kind, packed(at, F.coalesce(offset_of(v), F.lit(0))))


def _constructor(kind: Type) -> Callable:
    def make(args: list[Value]) -> Value:
        if len(args) > 1:
            raise QuerySyntaxError(f"InvalidNumberOfArguments ({kind.name})")
        if not args:
            return converted(kind, parsed(DATETIME, F.lit(EPOCH + "T00:00Z")))
        v = args[0]
        if v.type == STRING:
            return parsed(kind, v.col)
        if v.type.name == "map":
            return from_map(kind, v)
        return converted(kind, v) if v.type.name in KINDS else null(kind)

    return make


for _kind in KINDS.values():
    FUNCTIONS[_kind.name] = _constructor(_kind)
    for _clock_name in ("transaction", "statement", "realtime"):
        FUNCTIONS[f"{_kind.name}.{_clock_name}"] = _constructor(_kind)


def _from_epoch(args: list[Value]) -> Value:
    micros = args[0].col.cast("bigint") * 1_000_000 + (_div(args[1].col.cast("bigint"), 1000) if len(args) > 1 else 0)
    return Value(DATETIME, packed(micros, F.lit(0)))


FUNCTIONS["datetime.fromepoch"] = _from_epoch
FUNCTIONS["datetime.fromepochmillis"] = lambda args: Value(DATETIME, packed(args[0].col.cast("bigint") * 1000, F.lit(0)))

# -- truncation

_UNITS = {"day": DAY, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}


def _truncated_days(unit: str, day: Column) -> Column:
    d = date_of(day)
    year = F.year(d)
    start = lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1))
    if unit in ("week", "month", "quarter", "year"):
        return days_of(F.trunc(d, unit))
    if unit == "weekyear":
        return days_of(week_date(F.extract(F.lit("YEAROFWEEK"), d).cast("bigint"), _long(1), _long(1)))
    size = {"decade": 10, "century": 100, "millennium": 1000}.get(unit)
    if size is None:
        raise QuerySyntaxError(f"InvalidArgumentValue ({unit})")
    return days_of(start(year - F.pmod(year, F.lit(size))))


def _truncate(kind: Type) -> Callable:
    def run(args: list[Value]) -> Value:
        unit, v = args[0], args[1]
        if not unit.is_const or not isinstance(unit.const, str):
            raise QuerySyntaxError("InvalidArgumentValue (unit)")
        if v.type == STRING:
            v = parsed(DATETIME if kind in (DATETIME, LOCALDATETIME) else kind, v.col)
        if v.type.name not in KINDS:
            return null(kind)
        low, at = unit.const.lower(), local_micros(v)
        if low in _UNITS:
            at = at - F.pmod(at, _long(_UNITS[low]))
        elif v.type in (TIME, LOCALTIME):
            return null(kind)
        else:
            at = _truncated_days(low, _div(at, DAY)) * DAY
        if len(args) > 2 and args[2].type.name == "map":
            at = _overridden(at, _fields(args[2]), v.type in (TIME, LOCALTIME))
        offset = F.coalesce(offset_of(v), F.lit(0))
        if kind == DATE:
            return Value(DATE, date_of(_div(at, DAY)))
        if kind in (TIME, LOCALTIME):
            return Value(kind, packed(F.pmod(at, _long(DAY)), offset if kind == TIME else None))
        return Value(kind, ntz_of(at)) if kind == LOCALDATETIME else Value(kind, packed(at, offset))

    return run


def _overridden(at: Column, fields: dict[str, Value], timed: bool) -> Column:
    own = Value(LOCALTIME, packed(at)) if timed else Value(LOCALDATETIME, ntz_of(at))
    if "dayOfWeek" in fields and not timed:
        at = at + (fields["dayOfWeek"].col.cast("bigint") - 1) * DAY
        own = Value(LOCALDATETIME, ntz_of(at))
        fields = {k: v for k, v in fields.items() if k != "dayOfWeek"}
    clock = _time_part(fields | {"time": own})
    if timed:
        return clock
    return _date_part(fields | {"date": own}) * DAY + clock


for _kind in KINDS.values():
    FUNCTIONS[f"{_kind.name}.truncate"] = _truncate(_kind)

# -- durations


def make_duration(months: Column, days: Column, micros: Column) -> Column:
    """Fractions of months go into days and seconds, fractions of days into seconds."""
    months, days, micros = (x.cast("double") for x in (months, days, micros))
    whole = F.when(months < 0, F.ceil(months)).otherwise(F.floor(months))
    extra = (months - whole) * MONTH_SECONDS
    extra_days = F.when(extra < 0, F.ceil(extra / 86400)).otherwise(F.floor(extra / 86400))
    days, micros = days + extra_days, micros + (extra - extra_days * 86400) * 1_000_000
    whole_days = F.when(days < 0, F.ceil(days)).otherwise(F.floor(days))
    micros = micros + (days - whole_days) * DAY
    return F.struct(whole.cast("bigint").alias("months"), whole_days.cast("bigint").alias("days"), F.round(micros).cast("bigint").alias("micros"))


_MONTHS = {"years": 12, "quarters": 3, "months": 1}
_DAYS = {"weeks": 7, "days": 1}
_MICROS = {"hours": 3.6e9, "minutes": 6e7, "seconds": 1e6, "milliseconds": 1e3, "microseconds": 1.0, "nanoseconds": 1e-3}
_ISO = r"^(-?)P(?:(-?[\d.]+)Y)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)W)?(?:(-?[\d.]+)D)?(?:T(?:(-?[\d.]+)H)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)S)?)?$"


def duration(args: list[Value]) -> Value:
    v = args[0]
    if v.type == DURATION:
        return v
    if v.type.name == "map":
        fields = {k: x.col.cast("double") for k, x in _fields(v).items() if x.type.number}
        total = lambda units: sum((fields[k] * n for k, n in units.items() if k in fields), F.lit(0.0))
        return Value(DURATION, make_duration(total(_MONTHS), total(_DAYS), total(_MICROS)))
    if v.type == STRING:
        s = v.col
        part = lambda g: F.coalesce(F.regexp_extract(s, _ISO, g).try_cast("double"), F.lit(0.0))
        sign = F.when(F.startswith(s, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
        made = make_duration(sign * (part(2) * 12 + part(3)), sign * (part(4) * 7 + part(5)), sign * (part(6) * 3.6e9 + part(7) * 6e7 + part(8) * 1e6))
        return Value(DURATION, F.when(s.rlike(_ISO), made))
    return null(DURATION)


FUNCTIONS["duration"] = duration


def _pair(args: list[Value]) -> tuple[Value, Value] | None:
    out = []
    for v in args[:2]:
        if v.type == STRING:
            v = parsed(DATETIME, v.col)
        if v.type.name not in KINDS:
            return None
        out.append(v)
    return out[0], out[1]


def _moments(a: Value, b: Value) -> tuple[Column, Column, bool]:
    """Comparable local microseconds of both, and whether both are dated."""
    ta, tb = a.type in (TIME, LOCALTIME), b.type in (TIME, LOCALTIME)
    x, y = local_micros(a), local_micros(b)
    if ta != tb:  # the dated side lends its day
        day = _div(y if ta else x, DAY) * DAY
        x, y = (x + day, y) if ta else (x, y + day)
    if a.type in (TIME, DATETIME) and b.type in (TIME, DATETIME):
        y = y - (offset_of(b) - offset_of(a)).cast("bigint") * 1_000_000
    return x, y, not (ta or tb)


def _months_between(x: Column, y: Column) -> Column:
    """Whole calendar months from one moment to the other, towards zero."""
    d1, d2 = date_of(_div(x, DAY)), date_of(_div(y, DAY))
    rough = (F.year(d2) - F.year(d1)) * 12 + F.month(d2) - F.month(d1)
    reached = days_of(F.add_months(d1, rough.cast("int"))) * DAY + F.pmod(x, _long(DAY))
    return (rough + F.when((rough > 0) & (reached > y), F.lit(-1)).when((rough < 0) & (reached < y), F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def _between(mode: str) -> Callable:
    def run(args: list[Value]) -> Value:
        pair = _pair(args)
        if pair is None:
            return null(DURATION)
        x, y, dated = _moments(*pair)
        zero = _long(0)
        months, days, micros = zero, zero, y - x
        if mode in ("between", "months") and dated:
            months = _months_between(x, y)
            pivot = days_of(F.add_months(date_of(_div(x, DAY)), months.cast("int"))) * DAY + F.pmod(x, _long(DAY))
            micros = y - pivot
        if mode == "months":
            micros = zero
        if mode in ("between", "days"):
            days = _trunc_div(micros, DAY)
            micros = F.try_mod(micros, _long(DAY)) if mode == "between" else zero
        known = x.isNotNull() & y.isNotNull()
        return Value(DURATION, F.when(known, F.struct(months.alias("months"), days.alias("days"), micros.alias("micros"))))

    return run


for _name, _mode in (("between", "between"), ("inmonths", "months"), ("indays", "days"), ("inseconds", "seconds")):
    FUNCTIONS[f"duration.{_name}"] = _between(_mode)


def scaled(v: Value, by: Value, divide: bool = False) -> Value:
    if not by.type.number:
        return null(DURATION)
    n = by.col.cast("double")
    n = F.when(n != 0, 1 / F.when(n != 0, n)) if divide else n
    return Value(DURATION, F.when(v.col.isNotNull() & n.isNotNull(), make_duration(v.col["months"] * n, v.col["days"] * n, v.col["micros"] * n)))


def shifted(t: Value, d: Value, sign: int) -> Value:
    months, days, micros = (d.col[k] * sign for k in ("months", "days", "micros"))
    if t.type == STRING:
        return null()
    if t.type == DATE:
        moved = F.date_add(F.add_months(t.col, months.cast("int")), (days + _trunc_div(micros, DAY)).cast("int"))
        return Value(DATE, moved)
    at = local_micros(t)
    if t.type in (TIME, LOCALTIME):
        return Value(t.type, packed(F.pmod(at + micros, _long(DAY)), offset_of(t)))
    day = F.date_add(F.add_months(date_of(_div(at, DAY)), months.cast("int")), days.cast("int"))
    moved = days_of(day) * DAY + F.pmod(at, _long(DAY)) + micros
    return Value(t.type, ntz_of(moved)) if t.type == LOCALDATETIME else Value(t.type, packed(moved, offset_of(t)))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op in ("+", "-") and a.type == b.type == DURATION:
        sign = 1 if op == "+" else -1
        return Value(DURATION, F.when(a.col.isNotNull() & b.col.isNotNull(), F.struct(*[(a.col[k] + b.col[k] * sign).alias(k) for k in ("months", "days", "micros")])))
    if op == "+" and a.type == DURATION and b.type.name in KINDS:
        return shifted(b, a, 1)
    if op in ("+", "-") and a.type.name in KINDS:
        return shifted(a, b, 1 if op == "+" else -1)
    if op == "*" and a.type == DURATION:
        return scaled(a, b)
    if op == "*" and b.type == DURATION:
        return scaled(b, a)
    if op == "/" and a.type == DURATION:
        return scaled(a, b, divide=True)
    return null()


def aligned(a: Value, b: Value) -> tuple[Value, Value]:
    """For comparison: text beside a temporal value is read as that kind."""
    if a.type.name in KINDS and b.type == STRING:
        return a, parsed(a.type, b.col)
    if b.type.name in KINDS and a.type == STRING:
        return parsed(b.type, a.col), b
    return a, b


# -- accessors


def accessor(v: Value, key: str) -> Value:
    if v.type == DURATION:
        return _duration_part(v, key)
    if v.type == STRING:  # text that reads as a date and time has their parts
        v = parsed(DATETIME, v.col)
    if key in ("timezone", "offset", "offsetMinutes", "offsetSeconds") and v.type in (TIME, DATETIME):
        offset = v.col["offset"]
        text = _offset_text(offset)
        return {"timezone": Value(STRING, F.coalesce(v.col["zone"], text)), "offset": Value(STRING, text), "offsetMinutes": Value(INT, _trunc_div(_long(offset), 60)), "offsetSeconds": Value(INT, _long(offset))}[key]
    at = local_micros(v)
    if v.type not in (TIME, LOCALTIME):
        d = date_of(_div(at, DAY))
        parts = {
            "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "weekYear": lambda x: F.extract(F.lit("YEAROFWEEK"), x), "day": F.dayofmonth, "ordinalDay": F.dayofyear,
            "weekDay": lambda x: F.weekday(x) + 1, "dayOfWeek": lambda x: F.weekday(x) + 1, "dayOfQuarter": lambda x: F.datediff(x, F.trunc(x, "quarter")) + 1,
        }
        if key in parts:
            return Value(INT, parts[key](d).cast("bigint"))
    if v.type == DATETIME and key in ("epochSeconds", "epochMillis"):
        utc = at - v.col["offset"].cast("bigint") * 1_000_000
        return Value(INT, _div(utc, 1_000_000 if key == "epochSeconds" else 1000))
    if v.type != DATE:
        seconds, rest = _div(F.pmod(at, _long(DAY)), 1_000_000), F.pmod(at, _long(1_000_000))
        parts = {"hour": _div(seconds, 3600), "minute": F.pmod(_div(seconds, 60), _long(60)), "second": F.pmod(seconds, _long(60)), "millisecond": _div(rest, 1000), "microsecond": rest, "nanosecond": rest * 1000}
        if key in parts:
            return Value(INT, parts[key])
    return null()


def _duration_part(v: Value, key: str) -> Value:
    months, days, micros = v.col["months"], v.col["days"], v.col["micros"]
    rest = F.pmod(micros, _long(1_000_000))
    parts = {
        "years": _div(months, 12), "quarters": _div(months, 3), "months": months, "weeks": _div(days, 7), "days": days, "hours": _div(micros, 3_600_000_000), "minutes": _div(micros, 60_000_000),
        "seconds": _div(micros, 1_000_000), "milliseconds": _div(micros, 1000), "microseconds": micros, "nanoseconds": micros * 1000, "quartersOfYear": F.pmod(_div(months, 3), _long(4)),
        "monthsOfQuarter": F.pmod(months, _long(3)), "monthsOfYear": F.pmod(months, _long(12)), "daysOfWeek": F.pmod(days, _long(7)), "minutesOfHour": F.pmod(_div(micros, 60_000_000), _long(60)),
        "secondsOfMinute": F.pmod(_div(micros, 1_000_000), _long(60)), "millisecondsOfSecond": _div(rest, 1000), "microsecondsOfSecond": rest, "nanosecondsOfSecond": rest * 1000,
    }
    return Value(INT, parts[key]) if key in parts else null()
