"""The exit-IP history log, one text line per record:
``<ISO-8601 UTC ts> port=<port> <ip> reason=<reason>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: line format and the IPv4 shape check
LINE_PATTERN = r"^(\S+) port=([0-9]+) (\S+) reason=(.*)$"
IPV4_SHAPE = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def read_flag_log(spark: SparkSession, path: str) -> DataFrame:
    """Text source; each file is split by Spark, lines are parsed in the JVM."""
    return parse_flag_lines(spark.read.text(path))


def parse_flag_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    v = F.col(col)
    ip = F.regexp_extract(v, LINE_PATTERN, 3)
    return lines.select(
        F.regexp_extract(v, LINE_PATTERN, 1).alias("ts_text"),
        F.regexp_extract(v, LINE_PATTERN, 2).try_cast("int").alias("port"),
        ip.alias("ip"),
        F.regexp_extract(v, LINE_PATTERN, 4).alias("reason"),
        ip.rlike(IPV4_SHAPE).alias("ip_valid"),
    )
