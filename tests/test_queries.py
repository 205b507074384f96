import pytest

from wavelode.plans import registry

from .compare import same

NAMES = list(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    out = registry.queries()[name](spark, sf)
    sql = registry.oracle_sql().get(name)
    if sql:
        same(out, duck.sql(sql))
    else:
        assert out.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_order_comes_from_keys(spark, sf):
    from wavelode.operators import soft_clip
    from wavelode.plans.samples import frames
    from pyspark.sql import functions as F

    loud = frames(spark, sf).withColumn("x", F.transform("x", lambda v: v * 5))
    runs = [{(r[0], r[1]): list(r[2]) for r in soft_clip.clip_streams(loud.repartition(n), "label", "vec_id", "x").collect()} for n in (1, 7)]
    assert runs[0] == runs[1]
