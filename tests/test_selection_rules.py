import pytest

from pathfold.operators.selection import check_query

FINE = (
    "SELECT activity_id FROM activities",
    "WITH a AS (SELECT * FROM activities), b AS (SELECT * FROM a) SELECT activity_id FROM b JOIN activities_full USING (activity_id)",
    "SELECT activity_id FROM activities WHERE activity_id IN (WITH x AS (SELECT activity_id FROM activities) SELECT * FROM x)",
    "WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT n AS activity_id FROM t",
    "WITH activities AS (SELECT * FROM activities) SELECT activity_id FROM Activities",
    "SELECT activity_id FROM activities_full LATERAL VIEW explode(track_points) AS p",
    "SELECT activity_id, t.v FROM activities, LATERAL explode(array(1, 2)) AS t(v)",
    "SELECT activity_id FROM activities WHERE exists(array(point_count), v -> v > 3)",
)
REFUSED = (
    "SELECT s.activity_id FROM secret s, (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret) t",
    "WITH a AS (SELECT * FROM b), b AS (SELECT * FROM activities) SELECT activity_id FROM a",
    "WITH t AS (SELECT activity_id FROM t) SELECT activity_id FROM t",
    "SELECT activity_id FROM activities WHERE EXISTS (WITH x AS (SELECT 1) SELECT * FROM y)",
    "SELECT (SELECT max(v) FROM secret) AS activity_id FROM activities",
    "SELECT id AS activity_id FROM range(10)",
    "SELECT * FROM sql_keywords()",
    "SELECT activity_id FROM spark_catalog.default.activities",
    "SELECT reflect('java.lang.System', 'nanoTime') AS activity_id FROM activities",
    "SELECT spark_catalog.default.f(1) AS activity_id FROM activities",
    "SELECT activity_id FROM IDENTIFIER('secret')",
)


@pytest.mark.parametrize("sql", FINE)
def test_queries_that_stay_inside(spark, sql):
    check_query(spark, sql)


@pytest.mark.parametrize("sql", REFUSED)
def test_queries_that_reach_outside(spark, sql):
    with pytest.raises(ValueError):
        check_query(spark, sql)
