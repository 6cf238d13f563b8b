"""Dates, durations and Kalman filters as expressions.

Temporal values are Spark timestamps and dates; a duration is a struct of months, days,
seconds and nanos. A Kalman state is a JSON text; a single step is an expression, and a
whole series is folded with ``fold_series``, ordered inside its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L = F.lit


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def ts(x: Column) -> Column:
    return x.try_cast("timestamp")


def part(name: str):
    return lambda x: F.call_function("date_part", L(name), ts(x)).cast("int")


def truncate(unit: Column, x: Column) -> Column:
    return F.call_function("date_trunc", unit, ts(x))


def duration(x: Column) -> Column:
    """An ISO 8601 duration (PnYnMnWnDTnHnMnS) as a struct."""
    g = lambda p: F.coalesce(F.regexp_extract(x, p, 1).try_cast("double"), L(0.0))
    date, time = r"^[^T]*?", r"T.*?"
    months = g(date + r"([\d.]+)Y") * 12 + g(date + r"([\d.]+)M")
    days = g(date + r"([\d.]+)W") * 7 + g(date + r"([\d.]+)D")
    secs = g(time + r"([\d.]+)H") * 3600 + g(time + r"([\d.]+)M") * 60 + g(time + r"([\d.]+)S")
    whole = F.floor(secs)
    return F.struct(months.cast("bigint").alias("months"), days.cast("bigint").alias("days"), whole.cast("bigint").alias("seconds"), F.round((secs - whole) * 1e9).cast("int").alias("nanos"))


def between(a: Column, b: Column) -> Column:
    """The absolute difference of two instants: days, seconds and nanos, never months."""
    us = F.abs(F.unix_micros(ts(b)) - F.unix_micros(ts(a)))
    return F.struct(L(0).cast("bigint").alias("months"), F.floor(us / 86_400_000_000).alias("days"), F.floor((us % 86_400_000_000) / 1_000_000).alias("seconds"), ((us % 1_000_000) * 1000).cast("int").alias("nanos"))


def in_seconds(d: Column) -> Column:
    """Total seconds; a month counts as 30 days."""
    return (d["months"] * 30 + d["days"]) * 86400 + d["seconds"] + d["nanos"] / 1e9


def add(x: Column, n: Column, unit: Column) -> Column:
    u = F.lower(unit)
    months = F.when(u.startswith("year"), n * 12).when(u.startswith("quarter"), n * 3).when(u.startswith("month"), n).otherwise(0)
    days = F.when(u.startswith("week"), n * 7).when(u.startswith("day"), n).otherwise(0)
    secs = F.when(u.startswith("hour"), n * 3600).when(u.startswith("min"), n * 60).when(u.startswith("sec"), n).when(u.startswith("milli") | (u == "ms"), n / 1000).otherwise(0)
    return ts(x) + F.make_interval(L(0), months.cast("int"), L(0), days.cast("int"), L(0), L(0), secs.cast("decimal(18,6)"))


UNIT_MS = {"ms": 1, "milli": 1, "milliseconds": 1, "s": 1000, "second": 1000, "seconds": 1000, "m": 60_000, "minute": 60_000, "minutes": 60_000, "h": 3_600_000, "hour": 3_600_000, "hours": 3_600_000, "d": 86_400_000, "day": 86_400_000, "days": 86_400_000, "week": 604_800_000, "weeks": 604_800_000}


def unit_ms(u: Column) -> Column:
    return F.create_map(*[y for k, v in UNIT_MS.items() for y in (L(k), L(v))])[F.lower(u)]


def difference(a: Column, b: Column, unit: Column) -> Column:
    return F.floor((F.unix_millis(ts(b)) - F.unix_millis(ts(a))) / unit_ms(unit)).cast("bigint")


def end_of(x: Column, unit: Column) -> Column:
    return add(truncate(unit, x), L(1), unit) - F.make_interval(secs=L(0.000001).cast("decimal(18,6)"))


def leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


# ---------- Kalman filters; fixed values: noise and starting variance by default
Q, R, P0 = 0.1, 88.0, 30.0
STATE = "x double, p double, lastx double, k double, r double, n bigint"


def _state(**f: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in f.items()]))


def kalman_init(initial: Column | None = None) -> Column:
    x = L(0.0) if initial is None else initial.cast("double")
    return _state(x=x, p=L(P0), lastx=x, k=L(0.0), r=L(R), n=L(0).cast("bigint"))


def scalar_step(s: Column, z: Column, q: float = Q) -> Column:
    """One step on a struct state: project by half of the last change, then correct."""
    drift = F.when(s["n"] > 1, (s["x"] - s["lastx"]) * 0.5).otherwise(0.0)
    x0, p0 = s["x"] + drift, s["p"] + q
    k = p0 / (p0 + s["r"])
    first = s["n"] == 0
    x = F.when(first, z).otherwise(x0 + k * (z - x0))
    return F.struct(x.alias("x"), F.when(first, s["p"]).otherwise((1 - k) * p0).alias("p"), F.when(first, z).otherwise(s["x"]).alias("lastx"), F.when(first, L(0.0)).otherwise(k).alias("k"), s["r"].alias("r"), (s["n"] + 1).alias("n"))


def kalman_process(z: Column, state: Column, target: Column | None = None) -> Column:
    s = F.from_json(state, STATE)
    n = scalar_step(s, z.cast("double"))
    return F.struct(n["x"].alias("value"), F.to_json(n).alias("state"))


def kalman_predict(state: Column, steps: Column) -> Column:
    s = F.from_json(state, STATE)
    return s["x"] + (s["x"] - s["lastx"]) * steps


def kalman_state(state: Column) -> Column:
    return F.get_json_object(state, "$.x").cast("double")


def kalman_reset(state: Column | None = None) -> Column:
    return kalman_init()


VSTATE = "pos double, vel double, p00 double, p01 double, p10 double, p11 double, n bigint"


def velocity_init(pos: Column | None = None, vel: Column | None = None) -> Column:
    z = L(0.0)
    return _state(pos=z if pos is None else pos.cast("double"), vel=z if vel is None else vel.cast("double"), p00=L(100.0), p01=z, p10=z, p11=L(10.0), n=L(0).cast("bigint"))


def velocity_step(s: Column, z: Column, dt: float = 1.0, qp: float = 0.1, qv: float = 0.01, r: float = 1.0) -> Column:
    """One step of the constant-velocity filter on a struct state."""
    pos = s["pos"] + s["vel"] * dt
    p00 = s["p00"] + dt * (s["p10"] + s["p01"]) + dt * dt * s["p11"] + qp
    p01, p10, p11 = s["p01"] + dt * s["p11"], s["p10"] + dt * s["p11"], s["p11"] + qv
    inn, sv = z - pos, p00 + r
    k0, k1 = p00 / sv, p10 / sv
    fields = {"pos": pos + k0 * inn, "vel": s["vel"] + k1 * inn, "p00": (1 - k0) * p00, "p01": (1 - k0) * p01, "p10": p10 - k1 * p00, "p11": p11 - k1 * p01}
    first = s["n"] == 0
    return F.struct(*[F.when(first, z if k == "pos" else s[k]).otherwise(v).alias(k) for k, v in fields.items()], (s["n"] + 1).alias("n"))


def velocity_process(z: Column, state: Column) -> Column:
    n = velocity_step(F.from_json(state, VSTATE), z.cast("double"))
    return F.struct(n["pos"].alias("value"), n["vel"].alias("velocity"), F.to_json(n).alias("state"))


def velocity_predict(state: Column, steps: Column) -> Column:
    s = F.from_json(state, VSTATE)
    return s["pos"] + s["vel"] * steps


def adaptive_init(initial: Column | None = None) -> Column:
    return F.to_json(F.struct(F.from_json(kalman_init(initial), STATE).alias("basic"), F.from_json(velocity_init(initial), VSTATE).alias("moving"), L(0.0).alias("trend"), L(False).alias("on")))


def adaptive_step(s: Column, z: Column, hot: float = 0.3, cold: float = 0.1) -> Column:
    """Both filters run; the moving one is used while the smoothed velocity says that there is a trend (with hysteresis)."""
    b, m = scalar_step(s["basic"], z), velocity_step(s["moving"], z)
    trend = s["trend"] * 0.8 + F.abs(m["vel"]) * 0.2
    on = F.when(trend > hot, True).when(trend < cold, False).otherwise(s["on"])
    return F.struct(b.alias("basic"), m.alias("moving"), trend.alias("trend"), on.alias("on"))


def adaptive_process(z: Column, state: Column) -> Column:
    n = adaptive_step(F.from_json(state, f"basic struct<{_ddl(STATE)}>, moving struct<{_ddl(VSTATE)}>, trend double, on boolean"), z.cast("double"))
    return F.struct(F.when(n["on"], n["moving"]["pos"]).otherwise(n["basic"]["x"]).alias("value"), F.to_json(n).alias("state"))


def _ddl(s: str) -> str:
    return ",".join(":".join(x.split()) for x in s.split(","))


def fold_series(df: DataFrame, key: str, order: str, value: str, kind: str = "scalar") -> DataFrame:
    """``key``, ``n`` and the last state's fields of a filter run over each key's values in order.

    One key's series is an ordered array in one row, so a key must fit a task; nulls are left out.
    """
    steps = {"scalar": (STATE, kalman_init, scalar_step), "velocity": (VSTATE, velocity_init, velocity_step)}
    ddl, init, step = steps[kind]
    rows = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("z")))).alias("zs"))
    state = F.aggregate("zs", F.from_json(init(), ddl), lambda s, z: step(s, z["z"]))
    return rows.select(key, F.size("zs").alias("n"), state.alias("state"))


FUNCTIONS = {
    "timestamp": now_millis,
    "datetime": lambda x=None: F.current_timestamp() if x is None else ts(x),
    "localdatetime": lambda x=None: F.current_timestamp() if x is None else ts(x),
    "date": lambda x=None: F.current_date() if x is None else x.try_cast("date"),
    "time": lambda x=None: F.date_format(F.current_timestamp() if x is None else ts(x), "HH:mm:ss"),
    "localtime": lambda x=None: F.date_format(F.current_timestamp() if x is None else ts(x), "HH:mm:ss"),
    "date.year": part("year"), "date.month": part("month"), "date.day": part("day"), "date.week": part("week"), "date.quarter": part("quarter"),
    "date.dayofweek": lambda x: F.weekday(ts(x)) + 1, "date.dayofyear": part("doy"), "date.ordinalday": part("doy"), "date.weekyear": part("yearofweek"),
    "date.truncate": lambda u, x: truncate(u, x).cast("date"), "datetime.truncate": truncate, "time.truncate": lambda u, x: F.date_format(truncate(u, x), "HH:mm:ss"),
    "datetime.hour": part("hour"), "datetime.minute": part("minute"), "datetime.second": part("second"), "datetime.year": part("year"), "datetime.month": part("month"), "datetime.day": part("day"),
    "duration": duration, "duration.between": between, "duration.inmonths": lambda d: d["months"], "duration.indays": lambda d: in_seconds(d) / 86400, "duration.inseconds": in_seconds,
}

# Under their namespaces date and temporal.
NAMED = {
    "date.format": lambda x, u=None, f=None: F.call_function("date_format", F.timestamp_millis(x), f if f is not None else L("yyyy-MM-dd HH:mm:ss")),
    "date.parse": lambda x, u=None, f=None: F.unix_millis(ts(x) if f is None else F.call_function("to_timestamp", x, f)),
    "date.currenttimestamp": now_millis,
    "date.fields": lambda x: F.struct(*[part(p)(x).alias(n) for n, p in (("years", "year"), ("months", "month"), ("days", "day"), ("hours", "hour"), ("minutes", "minute"), ("seconds", "second"))]),
    "date.add": lambda x, u, n, v: x + n * unit_ms(v) / unit_ms(u), "date.convert": lambda x, a, b: F.floor(x * unit_ms(a) / unit_ms(b)).cast("bigint"),
    "date.convertformat": lambda x, a, b: F.call_function("date_format", F.call_function("to_timestamp", x, a), b), "date.fromiso8601": lambda x: F.unix_millis(ts(x)),
    "date.toiso8601": lambda x, u=None: F.date_format(F.timestamp_millis(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "date.toyears": lambda x: x / 31_557_600_000, "date.systemtimezone": F.current_timezone,
    "date.tounixtime": lambda x: F.unix_timestamp(ts(x)), "date.fromunixtime": lambda x: F.timestamp_seconds(x), "date.parseaszoneddatetime": lambda x, f=None: ts(x) if f is None else F.call_function("to_timestamp", x, f),
    "temporal.format": lambda x, f: F.call_function("date_format", ts(x), f), "temporal.parse": lambda x, f: F.call_function("to_timestamp", x, f), "temporal.toepochmillis": lambda x: F.unix_millis(ts(x)),
    "temporal.fromepochmillis": lambda x: F.timestamp_millis(x), "temporal.add": add, "temporal.subtract": lambda x, n, u: add(x, -n, u), "temporal.difference": difference, "temporal.startof": lambda x, u: truncate(u, x), "temporal.endof": end_of,
    "temporal.isbetween": lambda x, a, b: ts(x).between(ts(a), ts(b)), "temporal.dayofweek": lambda x: F.dayofweek(ts(x)) - 1, "temporal.quarter": part("quarter"), "temporal.age": lambda x, y=None: F.floor(F.months_between(F.current_timestamp() if y is None else ts(y), ts(x)) / 12).cast("int"),
    "temporal.timezone": lambda x, z: F.convert_timezone(None, z, ts(x).cast("timestamp_ntz")), "temporal.duration": duration, "temporal.truncate": lambda x, u: truncate(u, x), "temporal.toutc": lambda x, z: F.to_utc_timestamp(ts(x), z), "temporal.tolocal": lambda x, z: F.from_utc_timestamp(ts(x), z),
    "temporal.isweekend": lambda x: F.dayofweek(ts(x)).isin(1, 7), "temporal.isweekday": lambda x: ~F.dayofweek(ts(x)).isin(1, 7), "temporal.dayofyear": part("doy"), "temporal.weekofyear": part("week"), "temporal.isleapyear": lambda x: leap(F.year(ts(x))),
    "temporal.daysinmonth": lambda x: F.dayofmonth(F.last_day(ts(x))), "temporal.round": lambda x, u: truncate(u, F.timestamp_millis((F.unix_millis(ts(x)) + unit_ms(u) / 2).cast("bigint"))),
    "temporal.formatduration": lambda d: F.format_string("%d days %d seconds", d["days"], d["seconds"]),
}


def field_of(x: Column, unit: Column) -> Column:
    u = F.lower(unit)
    c = None
    for names, p in ((("year", "years"), "year"), (("month", "months"), "month"), (("d", "day", "days"), "day"), (("h", "hour", "hours"), "hour"), (("m", "minute", "minutes"), "minute"), (("s", "second", "seconds"), "second")):
        v = F.call_function("date_part", L(p), x).cast("int")
        c = F.when(u.isin(*names), v) if c is None else c.when(u.isin(*names), v)
    return c


NAMED["date.field"] = lambda x, u: field_of(F.timestamp_millis(x), u)
