"""Sources and sinks: written under the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.panels import BASE, WEEK, panel
from checks.registry import add
from checks.statistics import FIN, arima_ctes, arima_path
from pricewell.models import arima as M
from pricewell.operators import catalog as C
from pricewell.operators import series as W
from pricewell.plans.session import new_path
from pricewell.schema import RAW_PRICES, SERIES_KEY
from pricewell.sources import prices as P
from pricewell.sources import sinks as K
from pricewell.sources.star import star_prices
from pricewell.streaming.ingest import ingest_new_files

COUNTS = "SELECT year, commodity, count(*) AS records, max(modal_price) AS top FROM prices {w} GROUP BY year, commodity"


def _counts(df):
    return df.groupBy("year", "commodity").agg(
        F.count("*").alias("records"), F.max("modal_price").alias("top"))


def _tree(s, d):
    root = new_path(s, "tree")
    P.write_tree(star_prices(s, d), root)
    return root


add("read_tree_of_years", lambda s, d: _counts(C.between_years(P.read_tree(s, _tree(s, d)), 1996, 1998)),
    COUNTS.format(w="WHERE year BETWEEN 1996 AND 1998"))


def _files(s, d):
    base, whole = new_path(s, "files"), new_path(s, "rows")
    star_prices(s, d).write.parquet(whole)  # the tables are joined once, not once a year
    rows = s.read.parquet(whole)
    for year in range(1995, 2002):  # one small job per yearly file
        rows.where(F.col("year") == year).write.parquet(P.year_paths(base, year, year)[0])
    return base


add("read_year_files", lambda s, d: _counts(P.open_prices(s, "auto", files=_files(s, d), years=(1997, 1999))),
    COUNTS.format(w="WHERE year BETWEEN 1997 AND 1999"))


def _view(s, d):
    C.register_prices(P.open_prices(s, "tree", tree=_tree(s, d)))
    return C.query(s, "SELECT state, count(*) AS records FROM prices GROUP BY state")


add("prices_view", _view, "SELECT state, count(*) AS records FROM prices GROUP BY state")


#: Raw files are compressed, and so many records at most go to one, as a compressed file is read by one task.
RAW_CODEC, RAW_RECORDS = "lz4", 250_000


def _write_raw(rows, path, fmt):
    (rows.write.option("header", True).option("compression", RAW_CODEC).option("maxRecordsPerFile", RAW_RECORDS)
     .format(fmt).save(path))


def _raw(s, d, fmt):
    path = new_path(s, "raw")
    _write_raw(star_prices(s, d).select(*RAW_PRICES.fieldNames()), path, fmt)
    return path


def _ingested(s, d, fmt):
    root = new_path(s, "ingested")
    P.ingest(s, _raw(s, d, fmt), root, fmt)
    return P.read_tree(s, root).groupBy("year", "month", "state").agg(
        F.count("*").alias("records"), F.max("modal_price").alias("top"))


_INGEST = """
SELECT year, month, 'Nation_' || substr(state, 8) AS state, count(*) AS records, max(modal_price) AS top
FROM prices GROUP BY year, month, state"""
add("ingest_json", lambda s, d: _ingested(s, d, "json"), _INGEST)
add("ingest_csv", lambda s, d: _ingested(s, d, "csv"), _INGEST)


#: A line that is no record, and one without a date.
BROKEN = ['{"state": "NATION_1", "arrival_date": "1996-02-', '{"state": "NATION_1", "modal_price": 5.0}']


def _two_batches(s, d):
    """Two batches of every year, the second with a corrected price for one month of the first, and broken lines."""
    root = new_path(s, "merged")
    rows = star_prices(s, d).select(*RAW_PRICES.fieldNames())
    month = F.month("arrival_date")
    for part in (rows.where(month <= 6), rows.where(month >= 6).withColumn(
            "modal_price", F.when(month == 6, F.col("modal_price") + 1000).otherwise(F.col("modal_price")))):
        path = new_path(s, "batch")
        _write_raw(part, path, "json")
        s.createDataFrame([(line,) for line in BROKEN], "value string").write.mode("append").text(path)
        P.ingest(s, path, root)
    tree = P.read_tree(s, root).groupBy("year", "month").agg(
        F.count("*").alias("records"), F.max("modal_price").alias("top"))
    kept = s.read.parquet(P.quarantine_path(root)).groupBy("reason").agg(F.count("*").alias("records"))
    none = {"year": F.lit(None).cast("int"), "month": F.lit(None).cast("int"), "top": F.lit(None).cast("double")}
    return tree.withColumn("reason", F.lit(None).cast("string")).unionByName(kept.withColumns(none))


add("ingest_two_batches", _two_batches, """
SELECT year, month, count(*) AS records, max(CASE WHEN month = 6 THEN modal_price + 1000 ELSE modal_price END) AS top,
       NULL::VARCHAR AS reason
FROM prices GROUP BY year, month
UNION ALL SELECT NULL, NULL, 2, NULL, 'unreadable' UNION ALL SELECT NULL, NULL, 2, NULL, 'no arrival_date'""")


def _streamed(s, d):
    root = new_path(s, "streamed")
    ingest_new_files(s, _raw(s, d, "json"), root, new_path(s, "progress"))
    return P.read_tree(s, root).groupBy("year", "month", "state").agg(
        F.count("*").alias("records"), F.max("modal_price").alias("top"))


add("ingest_new_files", _streamed, _INGEST)


def _table(s, d):
    name = f"pairs_{uuid.uuid4().hex[:12]}"
    rows = star_prices(s, d).groupBy(*SERIES_KEY).agg(F.count("*").alias("records"))
    K.write_table(rows, name, "append", new_path(s, "table"))
    # appended by position, whatever the names
    K.write_table(rows.toDF("a", "b", "c"), name, "append")
    return s.table(name)


add("write_table", _table, """
SELECT commodity, state, count(*) AS records FROM prices GROUP BY commodity, state
UNION ALL SELECT commodity, state, count(*) FROM prices GROUP BY commodity, state""")


def _replaced(s, d):
    name = f"pairs_{uuid.uuid4().hex[:12]}"
    path = new_path(s, "table")
    rows = star_prices(s, d).groupBy(*SERIES_KEY).agg(F.count("*").alias("records"))
    K.write_table(rows, name, "append", path)
    K.write_table(rows.where("records > 100"), name, "replace", path)
    return s.table(name)


add("replace_table", _replaced, """
SELECT commodity, state, count(*) AS records FROM prices GROUP BY commodity, state HAVING count(*) > 100""")


def _log(s, d):
    path = new_path(s, "log")
    p = panel(s, d)
    K.save_forecast(M.forecast(M.fit(p), 30, None), path)
    return K.read_log(s, path)


_LOG = """
SELECT commodity AS crop, state, 'ARIMA(1,1,1)' AS model, date AS forecast_date, round(f, 2) AS predicted_price FROM fc"""
_LOG_CTES = BASE + arima_ctes() + [FIN, arima_path(30)]
add("save_forecast", lambda s, d: _log(s, d).select(
    "crop", "state", "model", "forecast_date", F.round("predicted_price", 2).alias("predicted_price")),
    _LOG, ctes=_LOG_CTES, recursive=True)
add("recent_forecasts", lambda s, d: K.recent_forecasts(_log(s, d), 100).select(
    "crop", "state", "model", "forecast_date", F.round("predicted_price", 2).alias("predicted_price")),
    _LOG + " ORDER BY date DESC, commodity, state LIMIT 100", ctes=_LOG_CTES, recursive=True)


def _csv(s, d):
    path = new_path(s, "csv")
    K.export_csv(panel(s, d, "W"), path)
    return s.read.option("header", True).schema("commodity string, state string, date date, y double").csv(path)


add("export_csv", _csv, "SELECT * FROM weekly", ctes=WEEK)


def _csv_series(s, d):
    path = new_path(s, "clean")
    K.export_csv(star_prices(s, d).select(
        F.col("commodity").alias("crop"), "state", "arrival_date", "modal_price"), path)
    return W.csv_series(P.read_clean_csv(s, path), "brand#2", "nation_1")


add("csv_series", _csv_series, """
SELECT 'brand#2' AS commodity, 'nation_1' AS state, date, y FROM (
  SELECT c.date, last_value(m.y IGNORE NULLS) OVER (ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS y
  FROM (SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM m) c
  LEFT JOIN m ON m.date = c.date)""", ctes=["""
m AS (SELECT arrival_date AS date, median(modal_price) AS y FROM prices
      WHERE lower(trim(commodity)) = 'brand#2' AND contains(lower(state), 'nation_1') GROUP BY arrival_date)"""])
