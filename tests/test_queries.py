import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.plans import registry

from oracle import connection, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE_SQL:
        assert differences(df, registry.ORACLE_SQL[name], con) == []
    else:
        assert df.count() > 0


def test_dates_hours_beyond_99_hours(spark, tmp_path):
    """Ids of 100 hours and more are cut as in the SQL; the function itself keeps its hours."""
    rows = "SELECT id AS event_id, TIMESTAMP '2024-01-01 05:59:00' + make_interval(0, 0, 0, 0, id % 24) AS ts FROM VALUES (0L), (359999L), (360000L), (3600001L), (36000061L) AS t(id)"
    spark.sql(rows).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert differences(registry.QUERIES["dates_hours"](spark, str(tmp_path)), registry.ORACLE_SQL["dates_hours"], con) == []
    assert spark.range(1).select(dates.seconds_to_hms(F.lit(360000))).first()[0] == "100:00:00"
