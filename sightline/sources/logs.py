"""Access logs: readers and parsers for structured, combined and custom lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: host, user, time, method, uri, protocol, status, size, referrer, agent.
COMBINED = r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S*)\s*([^"]*)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
REQUEST = "struct<ts:string,request:struct<remote_ip:string,client_ip:string,method:string,host:string,uri:string,headers:map<string,array<string>>>,status:int,size:bigint,duration:double>"
COLUMNS = ("ts", "ip", "method", "uri", "host", "status", "size", "ua", "referer")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(line) of plain or gzipped logs; no path is a refusal, never an empty log."""
    if not paths:
        raise ValueError("no input was named: refusing to report on nothing")
    return spark.read.text(sorted(paths)).select(F.col("value").alias("line")).where(F.trim("line") != "")


def _real(value: Column) -> Column:
    """Null for empty values and unexpanded {placeholders}."""
    value = F.trim(value)
    return F.when((value != "") & ~value.rlike(r"^\{.*\}$"), value)


def _header(headers: Column, *names: str) -> Column:
    lowered = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.coalesce(*[_real(F.get(F.element_at(lowered, F.lit(n.lower())), F.lit(0))) for n in names])


def epoch(text: Column) -> Column:
    """Seconds of a number or an ISO time with zone."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def _structured(d: Column) -> tuple[Column, list[Column]]:
    """Whether a parsed JSON line is a record, and its COLUMNS."""
    headers = F.coalesce(d["request"]["headers"], F.create_map().cast("map<string,array<string>>"))
    forwarded = _real(F.split(_header(headers, "X-Forwarded-For"), ",")[0])
    ip = F.coalesce(_header(headers, "Cf-Connecting-Ip", "True-Client-IP"), forwarded, _real(d["request"]["client_ip"]), _real(d["request"]["remote_ip"]), F.lit(""))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return d["request"].isNotNull(), [
        F.timestamp_micros((epoch(d["ts"]) * 1e6).cast("long")).alias("ts"), ip.alias("ip"), empty(d["request"]["method"]).alias("method"), empty(d["request"]["uri"]).alias("uri"), empty(d["request"]["host"]).alias("host"),
        F.coalesce(d["status"], F.lit(0)).alias("status"), F.coalesce(d["size"], F.lit(0)).cast("long").alias("size"), empty(_header(headers, "User-Agent")).alias("ua"), empty(_header(headers, "Referer", "Referrer")).alias("referer"),
    ]


def parse_structured(line: Column) -> Column:
    """A struct of COLUMNS from a JSON line with a nested request; null for others."""
    read, fields = _structured(F.from_json(line, REQUEST))
    return F.when(read, F.struct(*fields))


def _combined(line: Column) -> tuple[Column, list[Column]]:
    """Whether a line is a combined or common one, and its COLUMNS."""
    g = lambda n: F.regexp_extract(line, COMBINED, n)
    referer = F.when(g(9) == "-", F.lit("")).otherwise(g(9))
    return line.rlike(COMBINED), [
        F.try_to_timestamp(g(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"), F.coalesce(_real(g(1)), F.lit("")).alias("ip"), g(4).alias("method"), g(5).alias("uri"), F.lit("").alias("host"),
        F.when(g(7) != "", g(7)).otherwise("0").cast("int").alias("status"), F.when(g(8).rlike(r"^\d+$"), g(8)).otherwise("0").cast("long").alias("size"), g(10).alias("ua"), referer.alias("referer"),
    ]


def parse_combined(line: Column) -> Column:
    """A struct of COLUMNS from a combined or common log line; null for others."""
    read, fields = _combined(line)
    return F.when(read, F.struct(*fields))


def parse_custom(line: Column, pattern: str, fields: list[str]) -> Column:
    """As parse_combined, for a user's own pattern whose groups are named by fields, with the usual other names."""

    def g(*names: str) -> Column:
        found = [F.nullif(F.regexp_extract(line, pattern, fields.index(n) + 1), F.lit("")) for n in names if n in fields]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")

    time = g("time", "ts", "datetime")
    fields_out = F.struct(
        F.coalesce(F.try_to_timestamp(time), F.try_to_timestamp(time, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))).alias("ts"), F.coalesce(_real(g("ip", "host")), F.lit("")).alias("ip"), g("method").alias("method"), g("uri", "path").alias("uri"), g("vhost").alias("host"),
        F.when(g("status").rlike(r"^\d+$"), g("status")).otherwise("0").cast("int").alias("status"), F.when(g("size").rlike(r"^\d+$"), g("size")).otherwise("0").cast("long").alias("size"), g("ua", "agent").alias("ua"), g("referer", "referrer").alias("referer"),
    )
    return F.when(line.rlike(pattern), fields_out)


def parse_any(line: Column) -> Column:
    """Structured where a line starts with a brace, else combined."""
    return F.when(F.ltrim(line).startswith("{"), parse_structured(line)).otherwise(parse_combined(line))


def parsed(lines: DataFrame, parse=parse_any) -> DataFrame:
    """Records with the line and whether it was read; unread lines have null columns.

    Of lines of either kind each column is made by itself, so that those nobody
    asks for are not.
    """
    if parse is not parse_any:
        return lines.withColumn("r", parse(F.col("line"))).select("line", F.col("r").isNotNull().alias("read"), "r.*")
    json = F.ltrim("line").startswith("{")
    (s_read, s_fields), (c_read, c_fields) = _structured(F.col("__d")), _combined(F.col("line"))
    rows = lines.withColumn("__d", F.when(json, F.from_json("line", REQUEST))).withColumn("read", F.coalesce(F.when(json, s_read).otherwise(c_read), F.lit(False)))
    each = [F.when(F.col("read"), F.when(json, s).otherwise(c)).alias(name) for name, s, c in zip(COLUMNS, s_fields, c_fields)]
    return rows.select("line", "read", *each)
