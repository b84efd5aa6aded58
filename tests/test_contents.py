"""content_hash over the whole table and over none of it."""

from pyspark.sql import functions as F

from quillon.operators.normalize import content_hash
from quillon.plans.catalogue_queries import QUERIES
from quillon.session import table


def test_all_reports_are_hashed(spark, data):
    got = QUERIES["report_contents"](spark, data).first()
    assert got["reports"] == table(spark, data, "raw_book").count() and 0 < got["contents"] <= got["reports"]


def test_no_reports(spark, data):
    rows = table(spark, data, "raw_book").limit(0)
    assert tuple(rows.agg(F.count("*"), F.count_distinct(content_hash(rows))).first()) == (0, 0)
