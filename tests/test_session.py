import os

from pointspark import session


def test_checkpoints_are_released(spark):
    rows = session.cut(spark.range(10))
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert rows.count() == 10 and os.listdir(at)
    session.release_checkpoints(spark)
    assert not os.listdir(at)
    assert session.cut(spark.range(5)).count() == 5
