"""Cohort retention as known at a point in time and as known at last: windows over clients, no join for the starts.

A client's start is the earliest known click of one kind. ``min(CASE kind)`` over a client's partition gives every row both
starts, of the early state and of the final one, so rows never meet a table of starts. Rows then explode into the states that know
them, and users are counted in two levels: first a row for each client and cell, then the cells.

Scale: a client with more than 1 / ``HOT`` of all rows is hot; there are fewer than ``HOT`` of them, whatever the input, so their ids fit
into the plan. A hot client's rows are dealt over ``SALTS`` partitions by a hash of the row. For each of these partitions one more row,
made by a partial aggregate of the hot client alone, carries the client's earliest starts, and the same window hands them to the rest. So
no partition holds more than about 1 / ``HOT`` of the rows of one client, and the other clients need no such row. All else is partial
aggregation before a shuffle. DataFrame functions only.

Nulls: clicks without ts or client are dropped; a null arrival counts as known only to the final state; a null id delays nothing; a null kind
is no start; a null or non-finite value is 0 cents. Equal rows count once. Ties in ts give the same start. An empty table of clicks gives no
cells, an empty table of clients the segment ''. Several rows of one client in ``clients``: the greatest non-null segment. Very long
texts in other columns only take part in the comparison of equal rows. Further columns of clicks, of whatever name, are part of a row and
make rows differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares of the rows: clients above 1 / HOT are spread over SALTS partitions.
HOT, SALTS = 1024, 256
DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, read as it stands: no session zone and no change of clocks takes part."""
    minutes = F.unix_date(ts.cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def crc(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def hot_clients(clicks: DataFrame, client: str = "client_id") -> list[int]:
    """Clients with more than 1 / ``HOT`` of the rows: fewer than ``HOT`` ids."""
    counts = clicks.groupBy(F.col(client).alias("c")).agg(F.count("*").alias("n"))
    least = (clicks.count() // HOT) + 1
    return [r[0] for r in counts.where(F.col("c").isNotNull() & (F.col("n") > least)).select("c").collect()]


def with_starts(rows: DataFrame, hot: list[int]) -> DataFrame:
    """``rows`` (client, at, early, start_kind, pick, ...) with ``start0`` and ``start1``: the client's earliest ``at`` of the start's kind, among
    early rows and among all. ``pick`` is a hash of the row that deals a hot client's rows."""
    firsts = [F.min(F.when(F.col("start_kind") & F.col("early"), F.col("at"))), F.min(F.when(F.col("start_kind"), F.col("at")))]
    if not hot:
        client = Window.partitionBy("client")
        return rows.select("*", firsts[0].over(client).alias("start0"), firsts[1].over(client).alias("start1"))
    is_hot = F.col("client").isin(hot)
    salted = rows.withColumn("salt", F.when(is_hot, F.pmod("pick", F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    heads = rows.where(is_hot).groupBy("client").agg(firsts[0].alias("first0"), firsts[1].alias("first1"))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = salted.unionByName(heads, allowMissingColumns=True)
    part = Window.partitionBy("client", "salt")
    seen = both.select("*", F.least(firsts[0].over(part), F.min("first0").over(part)).alias("start0"), F.least(firsts[1].over(part), F.min("first1").over(part)).alias("start1"))
    return seen.where(F.col("at").isNotNull()).drop("salt", "first0", "first1")


def retention(clicks: DataFrame, clients: DataFrame, until: str, days: int = 3, kind: str = "purchase", segment: str = "city") -> DataFrame:
    """(state, segment, cohort, period, users, users_crc32, moved, cents): the nonempty cells of both states; ``until``: the early state knows
    clicks that arrive before it. Cohorts and periods are ``days`` long."""
    known = clicks.where(F.col("ts").isNotNull() & F.col("client_id").isNotNull()).dropDuplicates()
    late = F.coalesce(F.pmod(crc(F.col("click_id")), F.lit(3)) == 0, F.lit(False))
    arrives = micros(F.col("arrived_at")) + F.when(late, F.pmod(crc(F.col("click_id")), F.lit(100)) * DAY).otherwise(F.lit(0))
    early = F.coalesce(arrives < micros(F.lit(until).cast("timestamp_ntz")), F.lit(False))
    value = F.col("value").cast("double")
    cents = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(0)).otherwise(F.floor(100 * value + 0.5)).cast("long")
    pick = F.xxhash64(*clicks.columns)
    rows = known.select(F.col("client_id").alias("client"), micros(F.col("ts")).alias("at"), early.alias("early"), F.coalesce(F.col("kind") == kind, F.lit(False)).alias("start_kind"), cents.alias("cents"), pick.alias("pick"))
    seen = with_starts(rows, hot_clients(clicks.where(F.col("ts").isNotNull())))

    exact = lambda start: F.expr(f"(at - {start} - pmod(at - {start}, {days * DAY})) div {days * DAY}")
    state = lambda n, fits: F.when(F.coalesce(fits & (F.col("at") >= F.col(f"start{n}")), F.lit(False)), F.struct(F.lit(n).alias("state"), F.col(f"start{n}").alias("start"), exact(f"start{n}").alias("period")))
    moved = F.coalesce(_days(F.col("start0"), days) != _days(F.col("start1"), days), F.lit(False))
    told = seen.select("client", "cents", moved.alias("moved"), F.explode(F.array_compact(F.array(state(0, F.col("early")), state(1, F.lit(True))))).alias("s"))
    flat = told.select("client", "cents", "moved", "s.state", _days(F.col("s.start"), days).alias("cohort"), F.col("s.period").cast("long").alias("period"))
    users = flat.groupBy("state", "client", "cohort", "period").agg(F.sum("cents").alias("cents"), F.max("moved").alias("moved"))

    named = clients.groupBy(F.col("client_id").alias("client")).agg(F.max(F.col(segment)).alias("segment")).where(F.col("client").isNotNull())
    placed = users.join(named, "client", "left").withColumn("segment", F.coalesce("segment", F.lit("")))
    cells = placed.groupBy("state", "segment", "cohort", "period").agg(
        F.count("*").alias("users"), F.sum(crc(F.col("client"))).alias("users_crc32"), F.sum(F.col("moved").cast("long")).alias("moved"), F.sum("cents").alias("cents"))
    return cells.select(F.col("state").cast("int"), "segment", "cohort", "period", "users", "users_crc32", "moved", "cents")


def _days(start: Column, days: int) -> Column:
    """Floor of the day since 1970 by ``days``, in whole numbers."""
    size = F.lit(days * DAY)
    return ((start - F.pmod(start, size)) / size).cast("long")


def op12(spark, sf_dir: str) -> DataFrame:
    """Registered query: all clicks, as known before 2024-03-01 and as known at last, by clients' cities."""
    return retention(spark.read.parquet(f"{sf_dir}/clicks.parquet"), spark.read.parquet(f"{sf_dir}/clients.parquet"), "2024-03-01 00:00:00")


#: crc32 of a decimal text, by its table of 256 remainders.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"

OP12_SQL = rf"""
WITH crcs AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc_table FROM range(256) r(n)),
clean AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
hashed AS (SELECT *, {_CRC.format("click_id::VARCHAR")} AS h FROM clean, crcs),
timed AS (SELECT client_id, kind, value, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) + CASE WHEN h % 3 = 0 THEN (h % 100) * {DAY} ELSE 0 END < epoch_us(TIMESTAMP '2024-03-01 00:00:00'), false) AS early FROM hashed),
starts AS (SELECT client_id, min(us) FILTER (kind = 'purchase' AND early) AS start0, min(us) FILTER (kind = 'purchase') AS start1 FROM timed GROUP BY client_id),
told AS (SELECT 0 AS state, client_id, us, value, start0 AS start FROM timed JOIN starts USING (client_id) WHERE early
  UNION ALL SELECT 1, client_id, us, value, start1 FROM timed JOIN starts USING (client_id)),
flat AS (SELECT state, client_id, (start // {DAY}) // 3 AS cohort, (us - start) // {3 * DAY} AS period, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0 ELSE floor(100 * value + 0.5) END::BIGINT AS cents FROM told WHERE us >= start),
users AS (SELECT state, client_id, cohort, period, sum(cents) AS cents FROM flat GROUP BY ALL),
marked AS (SELECT u.*, coalesce(start0 // {3 * DAY} <> start1 // {3 * DAY}, false) AS moved, {_CRC.format("client_id::VARCHAR")} AS crc FROM users u JOIN starts USING (client_id), crcs),
named AS (SELECT client_id, max(city) AS city FROM clients GROUP BY client_id)
SELECT state::INTEGER AS state, coalesce(city, '') AS segment, cohort::BIGINT AS cohort, period::BIGINT AS period, count(*)::BIGINT AS users, sum(crc)::BIGINT AS users_crc32, count(*) FILTER (moved)::BIGINT AS moved, sum(cents)::BIGINT AS cents
FROM marked LEFT JOIN named USING (client_id) GROUP BY ALL
"""
