from pyspark.sql import functions as F

from crosslight.llm.common import _fingerprint


def test_p3_checksum_of_many_links(spark):
    links = spark.range(1_500_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    n, x = _fingerprint(links)
    assert n == 1_500_000 and (n, x) == _fingerprint(links.orderBy(F.desc("u"))) != _fingerprint(links.where("u > 0"))
