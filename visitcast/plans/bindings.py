"""The test tables as inputs of the jobs: DataFrames, and the same as DuckDB relations.

CTE holds named relations; with_(names, query) writes the WITH clause that they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITY = "ASIA"
AIR = ["click", "view", "purchase"]
WEATHER = ["error", "signup"]
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: Visits have this in place of LINE: a visit's columns follow from the keys of its line, so rows that the rest of LINE would order are equal.
KEYS = LINE[:3]
#: Up to so many suppliers are broadcast; more are shuffled.
SENT = 500_000
POLYGONS = {
    "A": [(0, 0), (5, 0), (5, 5), (0, 5)],
    "B": [(5, 0), (9, 0), (9, 8), (7, 8), (7, 5), (5, 5)],
    "C": [(0, 5), (5, 5), (4, 9), (1, 9)],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gender(key: str) -> F.Column:
    return F.when(F.col(key) % 10 == 0, F.lit(None)).when(F.col(key) % 2 == 0, "F").otherwise("M")


def _regions(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias(f"{name}_nation"), F.col("r_name").alias(name))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(_regions(spark, sf_dir, "district"), F.col("c_nationkey") == F.col("district_nation")).select("c_custkey", "district")


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(_regions(spark, sf_dir, "registered"), F.col("s_nationkey") == F.col("registered_nation")).select("s_suppkey", F.col("registered").alias("registered_address"))


def _met(spark: SparkSession, sf_dir: str, people: DataFrame) -> DataFrame:
    """KEYS of the lines with `people` by order and the region of the line's supplier.

    Suppliers are counted first: while they are few, they are broadcast to the lines that have met their orders, so that the
    lines aren't shuffled for them and are shuffled for the orders, as they are stored, with nothing but their keys.
    """
    known, lines = _registered(spark, sf_dir), table(spark, sf_dir, "lineitem").select(*KEYS)
    placed, ordered = F.col("l_suppkey") == F.col("s_suppkey"), F.col("l_orderkey") == F.col("o_orderkey")
    if table(spark, sf_dir, "supplier").count() <= SENT:
        return lines.join(people, ordered).join(F.broadcast(known), placed)
    return lines.join(known, placed).join(people, ordered)


def bare_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line that has an order, part, customer and supplier, with the line's KEYS alone; described() adds the rest.

    Both addresses are there before the parts are met, so that a filter on them runs before that join.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("visit_date"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gy_bm"), F.col("p_type").alias("disease"))
    people = orders.join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    joined = _met(spark, sf_dir, people).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.when(F.col("o_custkey") == 1, "01").otherwise(F.col("o_custkey").cast("string")).alias("patient_id"),
        "visit_date", "gy_bm", "disease", "district", F.col("district").alias("current_address"), "registered_address", *KEYS,
    )


def described(df: DataFrame) -> DataFrame:
    """df with gender and age, which follow from the patient: visits that are shuffled needn't carry them."""
    return df.withColumn("_key", F.col("patient_id").cast("long")).withColumns({"gender": _gender("_key"), "age": (F.col("_key") % 90 + 1).cast("int")}).drop("_key")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(bare_visits(spark, sf_dir))


def emergency(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return urgent.join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(F.to_date("o_orderdate").alias("visit_date"), "district", F.col("o_custkey").cast("string").alias("patient_id"))


def deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return final.join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(F.to_date("o_orderdate").alias("date"), "district", _gender("o_custkey").alias("gender"), (F.col("o_custkey") % 90 + 1).cast("int").alias("age"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start, end: the first and last day with visits, one row."""
    return table(spark, sf_dir, "orders").agg(F.min(F.to_date("o_orderdate")).alias("start"), F.max(F.to_date("o_orderdate")).alias("end"))


def placed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings moved so that their first day is the visits' first day: the two tables are of different years."""
    found = readings(spark, sf_dir)
    moved = found.agg(F.min(F.to_date("ts")).alias("_first")).join(F.broadcast(days(spark, sf_dir))).select(F.date_diff("_first", "start").alias("_shift"))
    return found.join(F.broadcast(moved)).withColumn("ts", F.date_sub(F.to_date("ts"), F.col("_shift"))).drop("_shift")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("district"))
    events = table(spark, sf_dir, "events").withColumn("station", (F.col("user_id") % 12).cast("int"))
    return events.join(F.broadcast(region), F.col("station") % 5 == F.col("r_regionkey")).select("ts", "district", F.col("event_type").alias("indicator"), "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """indicator, t (hour since the first day), value: means per hour; hours without a reading are gaps."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    first = events.agg(F.min(F.date_trunc("day", "ts")).alias("day0"))
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("day0").cast("timestamp"))) / 3_600_000_000)
    timed = events.join(F.broadcast(first)).select(F.col("event_type").alias("indicator"), hour.cast("int").alias("t"), "value")
    return timed.groupBy("indicator", "t").agg(F.avg("value").alias("value"))


def station_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """district, indicator, t (hour since the first day), value: means per hour; hours without a reading are gaps."""
    found = readings(spark, sf_dir)
    first = found.agg(F.min(F.date_trunc("day", "ts")).alias("day0"))
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("day0").cast("timestamp"))) / 3_600_000_000)
    timed = found.join(F.broadcast(first)).select("district", "indicator", hour.cast("int").alias("t"), "value")
    return timed.groupBy("district", "indicator", "t").agg(F.avg("value").alias("value"))


#: Raw texts of an order, as SQL of both engines but for the dates' spellings.
RAW_TEXTS = {
    "age_text": "CASE o_orderkey % 4 WHEN 0 THEN ' ' || CAST(o_orderkey % 130 AS VARCHAR(9)) || ' years' WHEN 1 THEN 'abc' WHEN 2 THEN '-' || CAST(o_orderkey % 9 AS VARCHAR(9)) ELSE CAST(o_orderkey % 130 AS VARCHAR(9)) END",
    "gender_text": "CASE o_orderkey % 6 WHEN 0 THEN ' male ' WHEN 1 THEN 'F' WHEN 2 THEN '2' WHEN 3 THEN 'x' WHEN 4 THEN NULL ELSE 'Female' END",
    "date_text": "CASE o_orderkey % 4 WHEN 0 THEN {iso} WHEN 1 THEN {slash} WHEN 2 THEN {packed} ELSE 'junk' END",
}
SPARK_DATES = {"iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "slash": "date_format(o_orderdate, 'yyyy/M/d')", "packed": "date_format(o_orderdate, 'yyyyMMdd')"}
DUCK_DATES = {"iso": "strftime(o_orderdate, '%Y-%m-%d')", "slash": "strftime(o_orderdate, '%Y/%-m/%-d')", "packed": "strftime(o_orderdate, '%Y%m%d')"}


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey and raw texts of age, gender and date."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", *[f"{x.format(**SPARK_DATES)} AS {c}" for c, x in RAW_TEXTS.items()])


def raw_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visits before cleaning: texts of age, gender, date, disease and addresses; KEYS of the lines, as in visits()."""
    part = dirty(spark, sf_dir, "p_brand").select("p_partkey", F.col("p_brand").alias("gy_bm"), F.col("raw").alias("disease_raw"))
    people = raw_texts(spark, sf_dir).join(addresses(spark, sf_dir).withColumnRenamed("address", "current_address"), F.col("o_custkey") == F.col("c_custkey"))
    joined = _met(spark, sf_dir, people).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.when(F.col("o_custkey") == 1, "01").otherwise(F.col("o_custkey").cast("string")).alias("patient_id"), "gy_bm", *RAW_TEXTS, "disease_raw", "current_address", "registered_address", *KEYS)


def icd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name: the distinct part names, numbered in order (a dimension of 64 rows)."""
    from pyspark.sql.window import Window

    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select(F.concat(F.lit("D"), F.lpad(F.row_number().over(Window.orderBy("name")).cast("string"), 3, "0")).alias("code"), "name")


def dirty(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """p_partkey, raw and columns of the parts: part names less the character that the key points at; every seventh key keeps its name."""
    at = (F.col("p_partkey") % F.length("p_name")).cast("int")
    cut = F.concat(F.substring(F.col("p_name"), F.lit(1), at), F.substring(F.col("p_name"), at + 2, F.length("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(cut).alias("raw"), *more)


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("D00_D01", "D00", "D01"), ("D02_D03", "D02", "D03"), ("D04_D05", "D04", "D05")], "block string, lo string, hi string")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_acctbal") + 1000) / 1000).alias("lon"), (F.col("c_custkey") % 97 / 10).alias("lat"))


def polygons(spark: SparkSession) -> DataFrame:
    rows = [(d, [(float(x), float(y)) for x, y in ring]) for d, ring in POLYGONS.items()]
    return spark.createDataFrame(rows, "district string, ring array<struct<x:double,y:double>>")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, address: segment, region and name in one text; every fifth customer's region is left out."""
    joined = table(spark, sf_dir, "customer").join(_regions(spark, sf_dir, "district"), F.col("c_nationkey") == F.col("district_nation"))
    return joined.select("c_custkey", F.concat_ws(" ", "c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("district")), "c_name").alias("address"))


_PEOPLE = "CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(1 + o_custkey % 90 AS INTEGER) AS age"
_DISTRICT = "JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey"
_EDGES = " UNION ALL ".join(f"SELECT '{d}' AS district, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2" for d, ring in POLYGONS.items() for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))

CTE = {
    "visits": f"""SELECT CASE WHEN o_custkey = 1 THEN '01' ELSE CAST(o_custkey AS VARCHAR) END AS patient_id, CAST(o_orderdate AS DATE) AS visit_date, p_brand AS gy_bm,
      p_type AS disease, cr.r_name AS district, cr.r_name AS current_address, sr.r_name AS registered_address, {_PEOPLE}, {', '.join(LINE)}
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey {_DISTRICT} JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey""",
    "city": f"SELECT * FROM visits WHERE (current_address LIKE '%{CITY}%' OR registered_address LIKE '%{CITY}%') AND patient_id <> '01'",
    "clean": f"SELECT * FROM city QUALIFY row_number() OVER (PARTITION BY patient_id, visit_date, gy_bm ORDER BY {', '.join(LINE)}) = 1",
    "raw_visits": f"""SELECT CASE WHEN o_custkey = 1 THEN '01' ELSE CAST(o_custkey AS VARCHAR) END AS patient_id, p_brand AS gy_bm, c_custkey, {', '.join(f"{x.format(**DUCK_DATES)} AS {c}" for c, x in RAW_TEXTS.items())},
      CAST(o_orderdate AS DATE) AS day, raw, address AS current_address, sr.r_name AS registered_address, {', '.join(LINE)} FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = part.p_partkey
      JOIN dirty ON dirty.p_partkey = part.p_partkey JOIN addresses ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey""",
    "emergency": f"SELECT CAST(o_orderdate AS DATE) AS visit_date, cr.r_name AS district FROM orders {_DISTRICT} WHERE o_orderpriority = '1-URGENT'",
    "deaths": f"SELECT CAST(o_orderdate AS DATE) AS date, cr.r_name AS district, {_PEOPLE} FROM orders {_DISTRICT} WHERE o_orderstatus = 'F'",
    "readings": "SELECT ts, r_name AS district, event_type AS indicator, value FROM events JOIN region ON CAST(user_id % 12 AS INTEGER) % 5 = r_regionkey",
    "hourly": """SELECT indicator, t, avg(value) AS value FROM (SELECT event_type AS indicator, value,
      CAST(floor((epoch_us(ts) - (SELECT epoch_us(date_trunc('day', min(ts))) FROM events)) / 3600000000) AS INTEGER) AS t FROM events)
      GROUP BY ALL""",
    "grid": """SELECT g.indicator, g.t, h.value FROM (SELECT indicator, CAST(unnest(range(min(t), max(t) + 1)) AS INTEGER) AS t FROM hourly GROUP BY indicator) g
      LEFT JOIN hourly h ON h.indicator = g.indicator AND h.t = g.t""",
    "station": """SELECT district, indicator, t, avg(value) AS value FROM (SELECT district, indicator, value,
      CAST(floor((epoch_us(ts) - (SELECT epoch_us(date_trunc('day', min(ts))) FROM readings)) / 3600000000) AS INTEGER) AS t FROM readings)
      GROUP BY ALL""",
    "station_grid": """SELECT g.district, g.indicator, g.t, h.value FROM (SELECT district, indicator, CAST(unnest(range(min(t), max(t) + 1)) AS INTEGER) AS t FROM station GROUP BY district, indicator) g
      LEFT JOIN station h ON h.district = g.district AND h.indicator = g.indicator AND h.t = g.t""",
    "days": "SELECT min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders",
    "icd": "SELECT 'D' || lpad(CAST(row_number() OVER (ORDER BY name) AS VARCHAR), 3, '0') AS code, name FROM (SELECT DISTINCT p_name AS name FROM part)",
    "dirty": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_name[1:p_partkey % length(p_name)] || p_name[p_partkey % length(p_name) + 2:] END AS raw FROM part""",
    "points": "SELECT c_custkey, (c_acctbal + 1000) / 1000 AS lon, c_custkey % 97 / 10 AS lat FROM customer",
    "edges": _EDGES,
    "addresses": """SELECT c_custkey, concat_ws(' ', c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN r_name END, c_name) AS address
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}


def with_(names: list[str], query: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names) + "\n" + query
