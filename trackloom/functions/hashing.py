"""The 31-fold hash used for bucketing and bucket sampling.

Every value hashes as Java does (strings by their UTF-8 bytes), and several
values fold as ``31 * h + hash``, all in 32-bit arithmetic. Spark's ``hash`` is
a different function. Bits of floating-point numbers are worked out with exact
products by powers of two, so everything is column arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = 0xFFFFFFFF


def _wrap(c: Column) -> Column:
    """Keep the low 32 bits as a signed int. ``c`` is named once, as folds nest this deeply."""
    return (c + (1 << 31)).bitwiseAND(F.lit(_MASK)) - (1 << 31)


def _long(c: Column) -> Column:
    return _wrap(c.bitwiseXOR(F.shiftrightunsigned(c, 32)))


def _bytes(c: Column, begin: int) -> Column:
    """The fold of the signed bytes of a binary column."""
    hexes = F.regexp_extract_all(F.hex(c), F.lit("(..)"), 1)
    codes = F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("bigint"))

    def fold(acc: Column, code: Column) -> Column:
        signed = F.when(code > 127, code - 256).otherwise(code)
        return (acc * 31 + signed).bitwiseAND(F.lit(_MASK))

    return _wrap(F.aggregate(codes, F.lit(begin).cast("bigint"), fold))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def float_bits(c: Column, double: bool = True) -> Column:
    """The IEEE 754 bits of a number as a bigint (the low 32 of it for single precision)."""
    digits, bias, all_bits = (52, 1023, 63) if double else (23, 127, 31)
    infinite = ((2 * bias + 1) << digits)
    lowest = 1 - bias
    size = F.abs(c.cast("double"))
    # -0.0 equals 0.0 everywhere but in print.
    negative = F.when((c < 0) | (c.cast("string") == "-0.0"), F.lit(-1 << all_bits)).otherwise(F.lit(0))

    def scaled(x: Column, shift: Column) -> Column:
        # In two steps, as one power may be out of range.
        half = F.floor(shift / 2)
        return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), shift - half)

    def normal(guess: Column) -> Column:
        whole = float(1 << digits)

        def exact(m: Column) -> Column:
            # The logarithm may be one off beside a power of two.
            shift = F.when(m >= 2 * whole, 1).when(m < whole, -1).otherwise(0)
            fraction = F.when(m >= 2 * whole, m / 2).when(m < whole, m * 2).otherwise(m)
            return (guess + shift + bias).cast("bigint") * (1 << digits) + (fraction - whole).cast("bigint")

        return _let(scaled(size, digits - guess), exact)

    tiny = scaled(size, F.lit(digits - lowest)).cast("bigint")
    # Below the least normal number there is no exponent; the guess keeps to what has one.
    bits = F.when(size < 2.0 ** lowest, tiny).otherwise(
        _let(F.greatest(F.floor(F.log2(size)), F.lit(lowest)), normal))
    return F.when(F.isnan(c), F.lit(infinite + (1 << (digits - 1)))).when(
        size == float("inf"), F.lit(infinite) + negative).otherwise(bits + negative)


def _decimal(c: Column, kind: T.DecimalType) -> Column:
    """31 times the hash of the digits, and the scale, without zeros at the end."""
    # Small numbers print with an exponent.
    printed = c.cast("string")
    text, power = F.split_part(printed, F.lit("E-"), F.lit(1)), F.split_part(printed, F.lit("E-"), F.lit(2))
    if kind.scale:
        text = F.when(F.instr(text, ".") > 0, F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    scale = F.when(F.instr(text, ".") > 0, F.length(text) - F.instr(text, ".")).otherwise(0)
    scale = (scale + F.coalesce(F.nullif(power, F.lit("")).cast("bigint"), F.lit(0))).cast("bigint")
    digits = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit("-"), F.lit("")).cast("decimal(38,0)")
    base = F.lit(1 << 32).cast("decimal(38,0)")

    def words(left: Column, n: int) -> Column:
        # From the lowest of n 32-bit words on; the highest counts first.
        if n == 0:
            return F.lit(0).cast("bigint")

        def step(pair: Column) -> Column:
            low = pair % base
            rest = ((pair - low) / base).cast("decimal(38,0)")
            return _wrap(words(rest, n - 1) * 31 + low.cast("bigint"))

        return _let(left, step)

    sign = F.when(c < 0, -1).otherwise(1)
    return F.when(c == 0, 0).otherwise(_wrap(_wrap(words(digits, 4) * sign) * 31 + scale))


def java_hash(c: Column, kind: T.DataType) -> Column:
    """32-bit hash of a value of any type, as a bigint; 0 for NULL."""
    if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
        h = c.cast("bigint")
    elif isinstance(kind, T.LongType):
        h = _long(c)
    elif isinstance(kind, T.FloatType):
        h = _wrap(float_bits(c, double=False))
    elif isinstance(kind, T.DoubleType):
        h = _let(float_bits(c), _long)
    elif isinstance(kind, T.DecimalType):
        h = _decimal(c, kind)
    elif isinstance(kind, T.StringType):
        h = _bytes(F.encode(c, "utf-8"), 0)
    elif isinstance(kind, T.BinaryType):
        h = _bytes(c, 1)
    elif isinstance(kind, T.DateType):
        h = F.unix_date(c).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        micros = F.unix_micros(c)
        seconds = F.floor(micros / 1_000_000)
        h = _let(F.shiftleft(seconds, 30).bitwiseOR(F.pmod(micros, F.lit(1_000_000)) * 1000), _long)
    elif isinstance(kind, T.ArrayType):
        h = F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: _wrap(a * 31 + java_hash(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        h = F.aggregate(F.map_entries(c), F.lit(0).cast("bigint"), lambda a, x: _wrap(
            a + java_hash(x["key"], kind.keyType).bitwiseXOR(java_hash(x["value"], kind.valueType))))
    elif isinstance(kind, T.StructType):
        h = F.when(c.isNotNull(), _fold([java_hash(c[f.name], f.dataType) for f in kind.fields]))
    elif isinstance(kind, T.NullType):
        h = F.lit(None).cast("bigint")
    else:
        raise ValueError(f"no bucket hash for {kind.simpleString()} columns")
    return F.coalesce(h, F.lit(0).cast("bigint"))


def _fold(hashes: list[Column]) -> Column:
    total = F.lit(0).cast("bigint")
    for h in hashes:
        total = _wrap(total * 31 + h)
    return total


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def hashable(df: DataFrame) -> list[Column]:
    """All columns in a form that Spark's hashes take: maps as sorted entries or JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType) and not _has_map(f.dataType.valueType):
            c = F.array_sort(F.map_entries(c))
        elif _has_map(f.dataType):
            c = F.to_json(F.struct(c))
        out.append(c)
    return out


def fold_hash(df: DataFrame, *values: Column | str) -> Column:
    """The hash of several columns or expressions of ``df``, as an int."""
    named = [F.col(v) if isinstance(v, str) else v for v in values]
    kinds = [f.dataType for f in df.select(*named).schema.fields]
    return _fold([java_hash(c, kind) for c, kind in zip(named, kinds)]).cast("int")


def bucket_of(df: DataFrame, buckets: int, *values: Column | str) -> Column:
    """Bucket number 0 .. buckets - 1."""
    return (fold_hash(df, *values).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF)) % buckets).cast("int")
