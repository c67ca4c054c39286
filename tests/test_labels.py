"""The author's call on cases written out: a standard class, mapped and other datasets, intervals."""

from pyspark.sql import functions as F

from evigrade.functions import labels as lb

#: standard, has_standard, is_mapped, mapped, reported, score, and the call; the one interval is [0, 3) Normal.
CASES = [
    ("aBNORMAL", True, True, "Normal", "normal", 1.0, "Abnormal"),
    (None, True, True, "Normal", "normal", 1.0, "Indeterminate"),
    (" nan ", True, False, None, None, 1.0, "Indeterminate"),
    ("Abnormal", False, False, None, None, 1.0, "Normal"),
    (None, False, False, None, "Abnormal", 1.0, "Normal"),
    (None, False, False, None, "Abnormal", None, "Indeterminate"),
    (None, False, False, "Abnormal", "depleted", 5.0, "Indeterminate"),
    (None, False, True, "Abnormal", "depleted", 1.0, "Abnormal"),
    (None, False, True, None, " Abnormal ", 1.0, "Abnormal"),
    (None, False, True, None, "odd", 1.0, "Normal"),
    (None, False, True, None, None, 3.0, "Indeterminate"),
]


def test_author_call(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, standard string, has_standard boolean, is_mapped boolean, mapped string, reported string, score double, want string")
    intervals = lb.interval_list([(F.lit("[0, 3)"), F.lit("normal"))])
    c = F.col
    call = lb.author_call(c("standard"), c("has_standard"), c("is_mapped"), c("mapped"), c("reported"), c("score"), intervals)
    assert [(r.i, r.got) for r in rows.select("i", call.alias("got"), "want").orderBy("i").collect()] == [(i, x[-1]) for i, x in enumerate(CASES)]
    none = lb.author_call(c("standard"), F.lit(False), c("is_mapped"), c("mapped"), c("reported"), c("score"), F.filter(intervals, lambda x: F.lit(False)))
    assert rows.where("i = 4").select(none).first()[0] == "Indeterminate"
