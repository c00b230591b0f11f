"""Log rows and log lines made from the given tables, alike in Spark and SQL, for the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_LEVELS = {"error": 5, "purchase": 4, "signup": 3, "view": 2, "click": 1}

#: The same as ``ev_log`` in DuckDB, as the body of a CTE.
EV = """ev AS (SELECT CAST(ts AS TIMESTAMP) AS timestamp, epoch_us(CAST(ts AS TIMESTAMP)) AS t,
  CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS level,
  'svc-' || (user_id % 6) AS source, event_id AS line_number, event_type,
  event_type || ' by user ' || user_id || ' zone ' || chr(CAST(97 + user_id % 26 AS INTEGER)) || ' ' || props AS message FROM events)"""


def utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def ev_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as log entries."""
    utc(spark)
    return as_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_log(events: DataFrame) -> DataFrame:
    """Event rows, of a table or a stream, as log entries."""
    level = F.lit(0)
    for name, k in EVENT_LEVELS.items():
        level = F.when(F.col("event_type") == name, k).otherwise(level)
    user = F.col("user_id")
    message = F.concat("event_type", F.lit(" by user "), user.cast("string"), F.lit(" zone "), F.expr("char(97 + user_id % 26)"), F.lit(" "), "props")
    return events.select(
        F.col("ts").cast("timestamp").alias("timestamp"), level.cast("int").alias("level"), F.concat(F.lit("svc-"), (user % 6).cast("string")).alias("source"),
        message.alias("message"), message.alias("raw_line"), F.col("event_id").alias("line_number"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )


#: Orders as the common content of rendered lines: k, ts (a second of its own day), level, message, customer.
ORDERS = """o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS ts,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 ELSE 3 END AS level,
  'order ' || o_orderkey || ' placed by customer ' || o_custkey AS message, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status FROM orders)"""


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    key = F.col("o_orderkey")
    level = F.when(F.col("o_orderpriority").startswith("1"), 5).when(F.col("o_orderpriority").startswith("2"), 4).otherwise(3)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("k"), F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + key % 86400).alias("ts"), level.alias("level"),
        F.concat(F.lit("order "), key.cast("string"), F.lit(" placed by customer "), F.col("o_custkey").cast("string")).alias("message"), F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderstatus").alias("status"),
    )


def rendered(fmt: str):
    """A line of the format with the content of an order row."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    word = F.when(F.col("level") == 5, "ERROR").when(F.col("level") == 4, "WARN").otherwise("INFO")
    severity = F.when(F.col("level") == 5, "11").when(F.col("level") == 4, "12").otherwise("14")
    code = F.when(F.col("level") == 5, "500").when(F.col("level") == 4, "404").otherwise("200")
    m, c = F.col("message"), F.col("customer")
    parts = {
        "json": ['{"timestamp":"', iso, '","level":"', F.lower(word), '","msg":"', m, '","customer":"', c, '"}'],
        "logfmt": ["time=", iso, " level=", word, ' msg="', m, '" customer=', c],
        "csv": [iso, ",", word, ',"', m, '",', c],
        "syslog-rfc3164": ["<", severity, ">", F.date_format("ts", "MMM d HH:mm:ss"), " host", c, " shop[77]: ", m],
        "syslog-rfc5424": ["<", severity, ">1 ", iso, " host", c, " shop 77 - [a b=\"1\"] ", m],
        "clf": ["10.0.0.1 - - [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /o/', c, ' HTTP/1.1" ', code, " 12"],
        "docker-json": ['{"log":"', word, ": ", m, '\\n","stream":"stdout","time":"', iso, '"}'],
        "docker-compose": ["shop-1  | ", iso, " ", word, " ", m],
        "cloudwatch": ['{"@timestamp":"', iso, '","@message":"', word, ": ", m, '","@logStream":"s', c, '"}'],
        "kubernetes": [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000000Z'"), " stderr F ", word, " ", m],
        "generic": [iso, " ", word, " ", m],
        "raw": [word, ": ", m],
        "raw_words": [word, " ", m],
    }[fmt]
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
