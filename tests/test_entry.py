import __spark_entry__ as entry
from gleaner import queries as library


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(library.QUERIES) <= set(entry.queries()) and len(library.ORACLE_SQL) > 50


def test_state_queries_on_star_tables(spark, tmp_path):
    """Queries that read one table work on a folder that holds only that table."""
    events = [(i, f"2024-01-{1 + i % 28:02d}", i % 5, ["view", "click"][i % 2], float(i), f'{{"k": {i}}}') for i in range(60)]
    df = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", df["ts"].cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    sizes = {n: library.QUERIES[n](spark, str(tmp_path)).count() for n in ("latest_upsert", "json_props", "daily_counts", "rubric_total", "guarded_counters", "daily_counts_stream")}
    assert sizes["latest_upsert"] == 10 and sizes["json_props"] == sizes["rubric_total"] == 60 and sizes["daily_counts"] == sizes["daily_counts_stream"] > 0
