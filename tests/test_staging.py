"""Tables staged once, and again where their files have gone."""

import shutil

from evigrade.sources.staging import once


def test_once(spark):
    made = []
    make = lambda: made.append(1) or spark.range(3).withColumnRenamed("id", "x")
    first = once(spark, "test-once", "here", make)
    assert once(spark, "test-once", "here", make).count() == 3 and len(made) == 1
    assert once(spark, "test-once", "there", make).count() == 3 and len(made) == 2
    shutil.rmtree(first.inputFiles()[0].removeprefix("file://").rpartition("/")[0])
    assert once(spark, "test-once", "here", make).count() == 3 and len(made) == 3
