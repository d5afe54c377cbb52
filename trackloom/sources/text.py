"""Text formats: delimited with nested values, regular expressions, Base64."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "\\N"

# Fixed value: the fields of an object-store access log, one line per request.
ACCESS_LOG = (
    r'^(\S+) (\S+) \[(.*?)\] (\S+) (\S+) (\S+) (\S+) (\S+) "(.+)" (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) "(.*)" "(.*)"$'
)
ACCESS_LOG_FIELDS = (
    "bucketowner", "bucketname", "rdatetime", "rip", "requester", "requestid", "operation", "rkey",
    "requesturi", "httpstatus", "errorcode", "bytessent", "objsize", "totaltime", "turnaroundtime",
    "referer", "useragent",
)

ACCESS_LOG_COUNTS = ("httpstatus", "bytessent", "objsize", "totaltime", "turnaroundtime")


def _quoted(separator: str) -> str:
    """A separator as a regular expression that matches it literally."""
    return "".join("\\" + c if not c.isalnum() and ord(c) > 32 else c for c in separator)


def _base64_line(value: Column) -> Column:
    """Base64 without the line breaks Spark puts in after every 76 characters."""
    return F.regexp_replace(F.base64(value), r"[\r\n]+", "")


def separators(fields: str = "\x01", items: str = "\x02", keys: str = "\x03") -> list[str]:
    """Separators by level of nesting: fields, items, map keys, and then control characters.

    An array, struct or map at a level is cut at that level's separator; the values in an
    array or struct lie one level deeper, and those in a map two, as its keys take one.
    """
    deeper = [c for c in map(chr, range(4, 9)) if c not in (fields, items, keys)]
    return [fields, items, keys, *deeper]


# Characters that Unicode sets apart for internal use stand for escaped ones while a line
# is cut. The first is the escape itself, then \n, \r, and the separators in turn.
_INTERNAL = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def _codes(levels: list[str], escape: str) -> list[tuple[str, str, str]]:
    """(as in a value, as in a file, as while a line is cut), the escape first."""
    named = [(escape, escape), ("\n", "n"), ("\r", "r"), *[(s, s) for s in levels]]
    return [(plain, escape + code, mark) for (plain, code), mark in zip(named, _INTERNAL)]


def _unescaped(text: Column, codes: list[tuple[str, str, str]]) -> Column:
    for plain, _, mark in codes:
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _parsed(text: Column, kind: T.DataType, levels: list[str], level: int, codes: list) -> Column:
    text = F.when(text != NULL_MARK, text)
    if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = _unescaped(text, codes)
        if isinstance(kind, T.BinaryType):
            return F.unbase64(text)
        return text if isinstance(kind, T.StringType) else text.try_cast(kind)
    parts = F.split(text, _quoted(levels[level]))
    if isinstance(kind, T.ArrayType):
        return F.transform(parts, lambda p: _parsed(p, kind.elementType, levels, level + 1, codes))
    if isinstance(kind, T.MapType):
        raw = F.str_to_map(text, F.lit(_quoted(levels[level])), F.lit(_quoted(levels[level + 1])))
        return F.map_from_entries(F.transform(F.map_entries(raw), lambda e: F.struct(
            _parsed(e["key"], kind.keyType, levels, level + 2, codes),
            _parsed(e["value"], kind.valueType, levels, level + 2, codes))))
    fields = [_parsed(F.get(parts, F.lit(i)), f.dataType, levels, level + 1, codes).alias(f.name)
              for i, f in enumerate(kind.fields)]
    return F.when(text.isNotNull(), F.struct(*fields))


def _safe(text: Column, levels: list[str], codes: list) -> Column:
    """Text whose special characters are escaped, or which has none; else the job fails."""
    marks = "[" + "".join(_INTERNAL) + "]"
    bad = text.rlike(marks)
    if not codes:
        bad = bad | text.rlike("[\\r\\n]")
        for s in levels:
            bad = bad | text.contains(s)
    message = F.concat(F.lit("a value holds a separator or line break, which needs an escape character: "), text)
    text = F.when(bad, F.raise_error(message)).otherwise(text)
    for plain, written, _ in codes:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _printed(value: Column, kind: T.DataType, levels: list[str], level: int, codes: list) -> Column:
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(
            value, lambda v: _printed(v, kind.elementType, levels, level + 1, codes)), levels[level])
    elif isinstance(kind, T.MapType):
        text = F.array_join(F.transform(F.map_entries(value), lambda e: F.concat(
            _printed(e["key"], kind.keyType, levels, level + 2, codes), F.lit(levels[level + 1]),
            _printed(e["value"], kind.valueType, levels, level + 2, codes))), levels[level])
    elif isinstance(kind, T.StructType):
        text = F.when(value.isNotNull(), F.concat_ws(levels[level], *[
            _printed(value[f.name], f.dataType, levels, level + 1, codes) for f in kind.fields]))
    elif isinstance(kind, T.BinaryType):
        text = _base64_line(value)
    elif isinstance(kind, T.StringType):
        text = _safe(value, levels, codes)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(NULL_MARK))


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str,
    fields: str = "\x01", items: str = "\x02", keys: str = "\x03", escape: str | None = None,
) -> DataFrame:
    """Text rows with separators by level of nesting (see :func:`separators`).

    Missing trailing fields, bad numbers and ``\\N`` read as NULL. After ``escape`` a
    separator or the escape itself stands for itself, ``n`` and ``r`` for line breaks.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    levels = separators(fields, items, keys)
    codes = _codes(levels, escape) if escape else []
    line = F.col("value")
    if escape:
        # The mark of NULL is no escape sequence.
        null = _INTERNAL[-1]
        line = F.replace(line, F.lit(escape * 2), F.lit(codes[0][2]))
        line = F.replace(line, F.lit(NULL_MARK), F.lit(null))
        for _, written, mark in codes[1:]:
            line = F.replace(line, F.lit(written), F.lit(mark))
        line = F.replace(line, F.lit(null), F.lit(NULL_MARK))
    parts = F.split(line, _quoted(fields), -1)
    lines = spark.read.text(path).select(parts.alias("_p"))
    return lines.select(*[
        _parsed(F.get("_p", F.lit(i)), f.dataType, levels, 1, codes).alias(f.name)
        for i, f in enumerate(wanted.fields)])


def write_delimited(
    df: DataFrame, path: str, mode: str = "error",
    fields: str = "\x01", items: str = "\x02", keys: str = "\x03", compression: str | None = None,
    escape: str | None = None,
) -> None:
    """Write what :func:`read_delimited` reads.

    Without ``escape`` a text that holds a separator or a line break fails the job, as it
    could not be read back.
    """
    levels = separators(fields, items, keys)
    codes = _codes(levels, escape) if escape else []
    columns = [_printed(F.col(f.name), f.dataType, levels, 1, codes) for f in df.schema.fields]
    writer = df.select(F.concat_ws(fields, *columns).alias("value")).write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def read_regex(
    spark: SparkSession, path: str | list[str], pattern: str, names: Sequence[str]
) -> DataFrame:
    """One column per group of a pattern that must match the whole line; else NULLs."""
    line = F.col("value")
    matches = line.rlike(pattern)
    return spark.read.text(path).select(*[
        F.when(matches, F.regexp_extract(line, pattern, i + 1)).alias(n) for i, n in enumerate(names)])


def read_access_log(spark: SparkSession, path: str | list[str], typed: bool = False) -> DataFrame:
    """All fields as text, or the counts among them as whole numbers when ``typed`` (``-`` is NULL)."""
    log = read_regex(spark, path, ACCESS_LOG, ACCESS_LOG_FIELDS)
    return log.withColumns({c: F.expr(f"try_cast({c} AS bigint)") for c in ACCESS_LOG_COUNTS}) if typed else log


def read_base64(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of Base64 as a binary column ``value``."""
    return spark.read.text(path).select(F.unbase64("value").alias("value"))


def write_base64(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    df.select(_base64_line(F.col(column)).alias("value")).write.mode(mode).text(path)


def write_json_values(df: DataFrame, path: str, fields: str = "\x01", mode: str = "error") -> None:
    """Delimited text in which nested values are JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    columns = [
        F.coalesce(F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string"),
                   F.lit(NULL_MARK)) for f in df.schema.fields]
    df.select(F.concat_ws(fields, *columns).alias("value")).write.mode(mode).text(path)
