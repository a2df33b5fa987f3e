"""Scalar functions by name: each takes and gives Columns.

Everything here is a built-in expression except what stands in functions/udfs.py. Numbers behave the
same in any session: "/" of two LONGs truncates (as a double; "DIV" keeps the LONG), overflow of the
plain operators wraps and that of the EXACT ones fails, logarithms of 0 are -Infinity. Dates and times
come from the tick alone, not from the session's time zone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALARS: dict[str, Callable[..., Column]] = {}


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def add(**functions: Callable[..., Column]) -> None:
    SCALARS.update(functions)


def call(name: str, *args) -> Column:
    """A function by its name."""
    return SCALARS[name](*[_lit(a) for a in args])


# --- numbers --------------------------------------------------------------------------------------



def _log(x: Column, f) -> Column:
    x = x.cast("double")
    return F.when(x > 0, f(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def _same_number(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _int_div(a: Column, b: Column) -> Column:
    """Truncated, also for negative numbers."""
    q = F.abs(a) - F.pmod(F.abs(a), F.abs(b))
    return (F.signum(a) * F.signum(b) * q / F.abs(b)).cast("bigint")


def _floor_div(a: Column, b: Column) -> Column:
    q = _int_div(a, b)
    return q - F.when((a % b != 0) & ((a < 0) != (b < 0)), 1).otherwise(0)


def _rint(x: Column) -> Column:
    """Half to even."""
    low = F.floor(x).cast("double")
    rest = x - low
    even = F.pmod(low, F.lit(2.0)) == 0
    return F.when(rest > 0.5, low + 1).when(rest < 0.5, low).otherwise(F.when(even, low).otherwise(low + 1))


def _bit_reverse(x: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), 64, "0")), 2, -10).cast("bigint")


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _div(a: Column, b: Column) -> Column:
    whole = F.typeof(a).isin(*_WHOLE) & F.typeof(b).isin(*_WHOLE)
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    exact = _int_div(a.try_cast("bigint"), F.nullif(b.try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.when(whole, exact.cast("double")).otherwise(ratio)


def _wrapped(f, g):
    """f, or where it gives nothing for two numbers, which it does when a LONG overflows, the low 64 bits of the result."""
    turn, half = (F.lit(str(2**k)).cast("decimal(38,0)") for k in (64, 63))

    def run(a: Column, b: Column) -> Column:
        low = F.pmod(g(a.try_cast("decimal(20,0)"), b.try_cast("decimal(20,0)")).cast("decimal(38,0)"), turn)
        return F.coalesce(f(a, b), F.when(low >= half, low - turn).otherwise(low).try_cast("bigint"))

    return run


def _exact(f):
    """f, failing where it gives nothing for two numbers."""

    def run(a: Column, b: Column) -> Column:
        found = f(a, b)
        return F.when(found.isNotNull() | a.isNull() | b.isNull(), found).otherwise(F.raise_error(F.lit("overflow")).cast("bigint"))

    return run


def _int_exact(a: Column) -> Column:
    return F.when(a.between(-(2**31), 2**31 - 1) | a.isNull(), a.try_cast("int")).otherwise(F.raise_error(F.lit("overflow")).cast("int"))


SCALARS |= {
    "+": lambda a, b: _wrapped(F.try_add, lambda x, y: x + y)(a, b),
    "-": lambda a, b: _wrapped(F.try_subtract, lambda x, y: x - y)(a, b),
    "*": lambda a, b: _wrapped(F.try_multiply, lambda x, y: x * y)(a, b),
    "/": _div,
    "DIV": _int_div,
    "%": lambda a, b: a % b,
    "**": lambda a, b: F.pow(a, b),
    "==": _same_number,
    "!=": lambda a, b: ~_same_number(a, b),
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "~=": lambda a, b, tolerance: (F.abs(a - b) <= F.abs(tolerance)) | (F.isnan(a) & F.isnan(b)),
    "&&": lambda a, b: a & b,
    "AND": lambda a, b: a & b,
    "||": lambda a, b: a | b,
    "OR": lambda a, b: a | b,
    "!": lambda a: ~a,
    "NOT": lambda a: ~a,
    "&": lambda a, b: a.bitwiseAND(b),
    "|": lambda a, b: a.bitwiseOR(b),
    "^": lambda a, b: a.bitwiseXOR(b),
    "~": lambda a: F.bitwise_not(a),
    "<<": lambda a, b: F.call_function("shiftleft", a, b.cast("int")),
    ">>": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
    ">>>": lambda a, b: F.call_function("shiftrightunsigned", a, b.cast("int")),
    "REVBITS": _bit_reverse,
    "BITCOUNT": lambda a: F.bit_count(a),
    "BITGET": lambda a, n: F.call_function("getbit", a, n.cast("int")),
    "ABS": F.abs,
    "SIGNUM": F.signum,
    "FLOOR": lambda x: F.floor(x),
    "CEIL": lambda x: F.ceil(x),
    "ROUND": lambda x: F.floor(x + 0.5),
    "RINT": _rint,
    "SQRT": lambda x: F.sqrt(x),
    "CBRT": F.cbrt,
    "EXP": F.exp,
    "EXPM1": F.expm1,
    "LOG": lambda x: _log(x, F.log),
    "LOG10": lambda x: _log(x, F.log10),
    "LOG1P": lambda x: F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))),
    "SIN": F.sin,
    "COS": F.cos,
    "TAN": F.tan,
    "ASIN": F.asin,
    "ACOS": F.acos,
    "ATAN": F.atan,
    "ATAN2": lambda y, x: F.atan2(y, x),
    "SINH": F.sinh,
    "COSH": F.cosh,
    "TANH": F.tanh,
    "SIGMOID": lambda x: 1 / (1 + F.exp(-x)),
    "TORADIANS": F.radians,
    "TODEGREES": F.degrees,
    "HYPOT": lambda a, b: F.hypot(a, b),
    "COPYSIGN": lambda a, b: F.abs(a) * F.when(b < 0, -1.0).otherwise(1.0),
    "IEEEREMAINDER": lambda a, b: a - b * _rint(a / b),
    "SCALB": lambda x, n: x * F.pow(F.lit(2.0), n),
    "GETEXPONENT": lambda x: F.floor(F.log2(F.abs(x))).cast("int"),
    "FLOORDIV": _floor_div,
    "FLOORMOD": lambda a, b: a - b * _floor_div(a, b),
    "ADDEXACT": _exact(F.try_add),
    "SUBTRACTEXACT": _exact(F.try_subtract),
    "MULTIPLYEXACT": _exact(F.try_multiply),
    "INCREMENTEXACT": lambda a: _exact(F.try_add)(a, F.lit(1)),
    "DECREMENTEXACT": lambda a: _exact(F.try_subtract)(a, F.lit(1)),
    "NEGATEEXACT": lambda a: _exact(F.try_subtract)(F.lit(0), a),
    "TOINTEXACT": _int_exact,
    "MAX": lambda a, b: F.greatest(a, b),
    "MIN": lambda a, b: F.least(a, b),
    "ISNaN": lambda x: F.isnan(x),
    "ISNULL": lambda x: x.isNull(),
    "NaN": lambda: F.lit(float("nan")),
    "NULL": lambda: F.lit(None),
    "PI": lambda: F.lit(math.pi),
    "E": lambda: F.lit(math.e),
    "MINLONG": lambda: F.lit(-(2**63)),
    "MAXLONG": lambda: F.lit(2**63 - 1),
    "RAND": lambda: F.rand(),
    "SRAND": lambda seed=0: F.rand(seed),
    "TODOUBLE": lambda x: x.cast("double"),
    "TOLONG": lambda x: x.cast("bigint"),
    "TOBOOLEAN": lambda x: x.cast("boolean"),
    "TOSTRING": lambda x: x.cast("string"),
    "NPDF": lambda x, mu, sigma: F.exp(-F.pow((x - mu) / sigma, F.lit(2)) / 2) / (sigma * math.sqrt(2 * math.pi)),
    "TOHEX": lambda x: F.lower(F.lpad(F.hex(x), 16, "0")),
    "FROMHEX": lambda s: F.conv(s, 16, -10).cast("bigint"),
    "TOBIN": lambda x: F.lpad(F.bin(x), 64, "0"),
    "FROMBIN": lambda s: F.conv(s, 2, -10).cast("bigint"),
}

# --- strings --------------------------------------------------------------------------------------


def _match(s: Column, pattern: Column) -> Column:
    """Whether the pattern matches the whole string."""
    return F.regexp_like(s, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))


SCALARS |= {
    "TOUPPER": F.upper,
    "TOLOWER": F.lower,
    "TRIM": F.trim,
    "SIZE": lambda x: F.length(x),
    "REVERSE": F.reverse,
    "SUBSTRING": lambda s, start, n=None: F.substr(s, start + 1) if n is None else F.substr(s, start + 1, n),
    "SPLIT": lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))),
    "JOIN": lambda a, d: F.array_join(a, ",") if d is None else F.call_function("array_join", a, d),
    "CONCAT": lambda a, b: F.concat(a, b),
    "MATCH": _match,
    "REPLACEALL": lambda s, p, r: F.regexp_replace(s, p, r),
    "REPLACE": lambda s, p, r: F.concat(
        F.substr(s, F.lit(1), F.greatest(F.regexp_instr(s, p) - 1, F.lit(0))),
        F.regexp_replace(F.coalesce(F.regexp_substr(s, p), F.lit("")), p, r),
        F.when(F.regexp_instr(s, p) > 0, F.substr(s, F.regexp_instr(s, p) + F.length(F.regexp_substr(s, p)))).otherwise(s),
    ),
    "INDEXOF": lambda s, x: F.instr(s, x) - 1 if isinstance(x, str) else F.call_function("instr", s, x) - 1,
    "CONTAINS": lambda s, x: F.contains(s, x),
    "STRINGFORMAT": lambda f, *a: F.call_function("format_string", f, *a),
    "URLENCODE": F.url_encode,
    "URLDECODE": F.url_decode,
    "->HEX": lambda s: F.lower(F.hex(s)),
    "HEX->": lambda s: F.unhex(s),
    "->B64": lambda s: F.base64(s),
    "B64->": lambda s: F.unbase64(s),
    "->B64URL": lambda s: F.translate(F.regexp_replace(F.base64(s), "=", ""), "+/", "-_"),
    "B64URL->": lambda s: F.unbase64(F.translate(s, "-_", "+/")),
    "B64TOHEX": lambda s: F.lower(F.hex(F.unbase64(s))),
    "HEXTOB64": lambda s: F.base64(F.unhex(s)),
    "HEXTOBIN": lambda s: F.lpad(F.conv(s, 16, 2), 8, "0"),
    "BINTOHEX": lambda s: F.lower(F.conv(s, 2, 16)),
    "->BYTES": lambda s: F.encode(s, "utf-8"),
    "BYTES->": lambda b: F.decode(b, "utf-8"),
    "MD5": F.md5,
    "SHA1": F.sha1,
    "SHA224": lambda x: F.sha2(x, 224),
    "SHA256": lambda x: F.sha2(x, 256),
    "SHA384": lambda x: F.sha2(x, 384),
    "SHA512": lambda x: F.sha2(x, 512),
    "CRC32": lambda x: F.crc32(x),
    "HASH": lambda x: F.xxhash64(x),
    "UUID": lambda: F.uuid(),
}

# --- date and time --------------------------------------------------------------------------------

UNIT = {"w": 604_800_000_000, "d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}


def _local(tick: Column, zone: str = "UTC") -> Column:
    """The local date and time of a tick, without a zone."""
    t = F.timestamp_add("MICROSECOND", tick.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return t if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), t)


def _day(tick: Column) -> Column:
    return F.date_from_unix_date(F.floor(tick / F.lit(UNIT["d"])).cast("int"))


def _start(day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * UNIT["d"]


def _moved(tick: Column, day: Column) -> Column:
    """The time of day of a tick on another day."""
    return _start(day) + F.pmod(tick, F.lit(UNIT["d"]))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("bigint").cast("string"), 2, "0")


def _iso(t: Column) -> Column:
    rest = F.pmod(t, F.lit(UNIT["d"]))
    parts = [_two(F.floor(rest / UNIT["h"])), F.lit(":"), _two(F.floor(rest / UNIT["m"]) % 60), F.lit(":"), _two(F.floor(rest / UNIT["s"]) % 60), F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z")]
    return F.concat(_day(t).cast("string"), F.lit("T"), *parts)


def _elements(t: Column, zone: str = "UTC") -> Column:
    """Year, month, day, hour, minute, second, nanoseconds, day of year, day of week from Monday, ISO week."""
    local = _local(t, zone)
    return F.array(*[f(local).cast("bigint") for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)], F.pmod(t, F.lit(1_000_000)) * 1000, F.dayofyear(local).cast("bigint"), (F.weekday(local) + 1).cast("bigint"), F.weekofyear(local).cast("bigint"))


SCALARS |= {
    **{k: (lambda x, u=v: x * u) for k, v in UNIT.items()},
    "MSTU": lambda: F.lit(1_000),
    "STU": lambda: F.lit(1_000_000),
    "NOW": lambda: F.unix_micros(F.current_timestamp()),
    "AGO": lambda n: F.unix_micros(F.current_timestamp()) - n,
    "NOTBEFORE": lambda t: F.unix_micros(F.current_timestamp()) >= t,
    "NOTAFTER": lambda t: F.unix_micros(F.current_timestamp()) <= t,
    "ns": lambda x: x / 1000,
    "ps": lambda x: x / 1_000_000,
    "ISO8601": _iso,
    "TOTIMESTAMP": lambda s: F.unix_micros(F.to_timestamp(s)),
    "YEAR": lambda t: F.year(_local(t)),
    "MONTH": lambda t: F.month(_local(t)),
    "DAY": lambda t: F.dayofmonth(_local(t)),
    "WEEKDAY": lambda t: F.weekday(_local(t)) + 1,
    "HOUR": lambda t: F.hour(_local(t)),
    "MINUTE": lambda t: F.minute(_local(t)),
    "SECOND": lambda t: F.second(_local(t)),
    "DAYOFYEAR": lambda t: F.dayofyear(_local(t)),
    "ISOWEEK": lambda t: F.weekofyear(_local(t)),
    "TSELEMENTS": _elements,
    "->TSELEMENTS": _elements,
    "TSELEMENTS->": lambda y, mo, d, h, mi, s: _start(F.make_date(y, mo, d)) + h.cast("bigint") * UNIT["h"] + mi.cast("bigint") * UNIT["m"] + F.round(s.cast("double") * 1_000_000).cast("bigint"),
    "ADDDAYS": lambda t, n: t + n * UNIT["d"],
    "ADDMONTHS": lambda t, n: _moved(t, F.add_months(_day(t), n.cast("int"))),
    "ADDYEARS": lambda t, n: _moved(t, F.add_months(_day(t), (n * 12).cast("int"))),
    "ADDDURATION": lambda t, months, micros: _moved(t, F.add_months(_day(t), months.cast("int"))) + micros,
    "HUMANDURATION": lambda t: F.concat_ws("", F.expr("''"), F.floor(t / UNIT["d"]).cast("string"), F.lit("d"), F.floor(F.pmod(t, F.lit(UNIT["d"])) / UNIT["h"]).cast("string"), F.lit("h"), F.floor(F.pmod(t, F.lit(UNIT["h"])) / UNIT["m"]).cast("string"), F.lit("m"), F.format_string("%.6f", F.pmod(t, F.lit(UNIT["m"])) / 1e6), F.lit("s")),
    "ISODURATION": lambda t: F.concat(F.lit("PT"), F.format_string("%.6f", t / 1e6), F.lit("S")),
    "DURATION": lambda s: sum((F.coalesce(F.nullif(F.regexp_extract(s, p, 1), F.lit("")).cast("double"), F.lit(0.0)) * u for p, u in (("([0-9.]+)D", UNIT["d"]), ("([0-9.]+)H", UNIT["h"]), ("T(?:[0-9.]+H)?([0-9.]+)M", UNIT["m"]), ("([0-9.]+)S", UNIT["s"]))), F.lit(0.0)).cast("bigint"),
}

# --- collections ----------------------------------------------------------------------------------


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))


SCALARS |= {
    "UNION": lambda a, b: F.array_union(a, b),
    "INTERSECTION": lambda a, b: F.array_intersect(a, b),
    "DIFFERENCE": lambda a, b: F.array_except(a, b),
    "UNIQUE": F.array_distinct,
    "->SET": F.array_distinct,
    "LSORT": lambda a: F.array_sort(a),
    "LREVERSE": F.reverse,
    "SHUFFLE": lambda a: F.shuffle(a),
    "LSIZE": lambda a: F.size(a),
    "GET": lambda a, i: F.get(a, i),
    "GETKEY": lambda m, k: F.element_at(m, k),
    "SUBLIST": lambda a, start, n: F.slice(a, start + 1, n),
    "APPEND": lambda a, b: F.concat(a, b),
    "FLATTEN": F.flatten,
    "NONNULL": lambda a: F.filter(a, lambda x: x.isNotNull()),
    "LCONTAINS": lambda a, x: F.exists(a, lambda y: y.eqNullSafe(x)),
    "LINDEXOF": lambda a, x: F.filter(F.transform(a, lambda y, i: F.when(y.eqNullSafe(x), i)), lambda i: i.isNotNull()),
    "LMIN": F.array_min,
    "LMAX": F.array_max,
    "RANGE": _range,
    "ZIPLISTS": lambda a, b: F.arrays_zip(a, b),
    "KEYLIST": F.map_keys,
    "VALUELIST": F.map_values,
    "CONTAINSKEY": lambda m, k: F.map_contains_key(m, k),
    "CONTAINSVALUE": lambda m, v: F.array_contains(F.map_values(m), v),
    "MSORT": lambda m: F.map_from_entries(F.array_sort(F.map_entries(m))),
    "MSIZE": lambda m: F.size(m),
    "SUBMAP": lambda m, keys: F.map_filter(m, lambda k, v: F.array_contains(keys, k)),
    "PUT": lambda m, k, v: F.map_concat(F.map_filter(m, lambda x, y: x != k), F.create_map(k, v)),
    "REMOVE": lambda m, k: F.map_filter(m, lambda x, y: x != k),
    "->JSON": lambda x: F.to_json(x),
    "JSONGET": lambda s, path: F.call_function("get_json_object", s, path),
    "DOT": lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x),
    "NORM2": lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))),
    "SHAPE": lambda a: F.array(F.size(a), F.size(F.get(a, F.lit(0)))),
    "TRANSPOSE": lambda m: F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda r: F.get(r, j))),
    "TR": lambda m: F.aggregate(F.transform(m, lambda r, i: F.get(r, i)), F.lit(0.0), lambda s, x: s + x),
    "RESHAPE": lambda a, rows, cols: F.transform(F.sequence(F.lit(0), rows.cast("int") - 1), lambda i: F.slice(a, i * cols.cast("int") + 1, cols.cast("int"))),
    "CLONEREVERSE": F.reverse,
    "->LIST": lambda *c: F.array(*c),
    "->MAP": lambda *c: F.create_map(*c),
    "MAP->": F.map_entries,
    "UNMAP": F.map_entries,
    "LIST->": lambda a: F.posexplode(a),
    "UNLIST": lambda a: F.explode(a),
    "SET->": F.array_sort,
    "UNSET": lambda a: F.explode(a),
    "->V": lambda *c: F.array(*c),
    "V->": lambda a: a,
    "->VEC": lambda a: a.cast("array<double>"),
    "VEC->": lambda a: a,
    "->MAT": lambda a: a.cast("array<array<double>>"),
    "MAT->": lambda a: a,
    "JSON->": lambda s: F.try_parse_json(s),
    "SET": lambda a, value, at: F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x)),
    "+!": lambda a, x: F.array_append(a, x),
    "TYPEOF": F.typeof,
    "LFLATMAP": lambda a, f: F.flatten(F.transform(a, f)),
    "MMAP": lambda m, f: F.transform_values(m, f),
    "GROUPBY": lambda a, f: F.aggregate(F.array_distinct(F.transform(a, f)), F.array().cast("array<string>"), lambda s, k: F.array_append(s, F.to_json(F.struct(k.alias("key"), F.filter(a, lambda x: f(x).eqNullSafe(k)).alias("values"))))),
    "FILTERBY": lambda a, f, wanted: F.filter(a, lambda x: f(x).eqNullSafe(wanted)),
    "SORTBY": lambda a, f: F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(f(x).alias("k"), i.alias("i"), x.alias("x")))), lambda r: r["x"]),
    "SORTWITH": lambda a, f: F.array_sort(a, f),
    "CHECKSHAPE": lambda m: F.size(F.array_distinct(F.transform(m, lambda r: F.size(r)))) <= 1,
    "HULLSHAPE": lambda m: F.array(F.size(m), F.array_max(F.transform(m, lambda r: F.size(r)))),
    "PERMUTE": lambda m, order: m if list(order) == [0, 1] else SCALARS["TRANSPOSE"](m),
    "MATCHER": lambda pattern: lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
    "TEMPLATE": lambda text, m: F.aggregate(F.map_entries(m), text, lambda s, e: F.replace(s, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"])),
    "IFT": lambda cond, then: F.when(cond, then),
    "IFTE": lambda cond, then, other: F.when(cond, then).otherwise(other),
    "SWITCH": lambda cases, other: F.coalesce(*[F.when(c, v) for c, v in cases], other),
    "ASSERT": lambda cond: F.assert_true(cond),
    "ASSERTMSG": lambda cond, message: F.assert_true(cond, message),
    "FAIL": lambda: F.raise_error(F.lit("failed")),
    "MSGFAIL": lambda message: F.raise_error(message),
    "CALL": lambda name, *args: F.call_function(name, *args),
    "LMAP": lambda a, f: F.transform(a, f),
    "LFILTER": lambda a, f: F.filter(a, f),
    "MFILTER": lambda m, f: F.map_filter(m, f),
}


def _quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def _qmul(a: Column, b: Column) -> Column:
    return _quaternion(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def _qconj(a: Column) -> Column:
    return _quaternion(a["w"], -a["x"], -a["y"], -a["z"])


def _qdivide(q: Column, r: Column) -> Column:
    """q times the inverse of r."""
    n = r["w"] * r["w"] + r["x"] * r["x"] + r["y"] * r["y"] + r["z"] * r["z"]
    p = _qmul(q, _qconj(r))
    return _quaternion(*[p[c] / n for c in "wxyz"])


def _rotation(q: Column) -> Column:
    """The axis and the angle in degrees that a unit quaternion turns by."""
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - q["w"] * q["w"]))
    part = lambda c: F.when(s > 1e-9, q[c] / s).otherwise(F.lit(1.0 if c == "x" else 0.0))
    angle = F.degrees(2 * F.acos(F.least(F.greatest(q["w"], F.lit(-1.0)), F.lit(1.0))))
    return F.struct(part("x").alias("x"), part("y").alias("y"), part("z").alias("z"), angle.alias("angle"))


def _from_rotation(x: Column, y: Column, z: Column, angle: Column) -> Column:
    n, half = F.sqrt(x * x + y * y + z * z), F.radians(angle) / 2
    return _quaternion(F.cos(half), *[F.sin(half) * c / n for c in (x, y, z)])


SCALARS |= {
    "Q->": lambda q: F.array(*[q[c] for c in "wxyz"]),
    "QDIVIDE": _qdivide,
    "QROTATION": _rotation,
    "ROTATIONQ": _from_rotation,
    "pi": lambda: F.lit(math.pi),
    "e": lambda: F.lit(math.e),
    "RANDOM": lambda low, high: low + F.rand() * (high - low),
    "PRNG": lambda seed=0: F.rand(seed),
    "->Q": _quaternion,
    "QCONJUGATE": _qconj,
    "QMULTIPLY": _qmul,
    "QROTATE": lambda q, x, y, z: _qmul(_qmul(q, _quaternion(F.lit(0.0), x, y, z)), _qconj(q)),
}
