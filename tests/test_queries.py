import pytest

from skyloom.plans import queries as Q
from skyloom.plans import sinks  # noqa: F401  registers its queries too
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, con, name):
    same(Q.QUERIES[name](spark, SF), con, Q.SQL[name])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_views_are_read(spark):
    run = lambda name: Q.QUERIES[name](spark, SF)
    halos, particles = Q.view(spark, SF, "halos_a"), Q.view(spark, SF, "particles")
    j6 = run("j6_match_properties")
    assert j6.count() == particles.select("id", "replication", "fof_halo_tag").distinct().count() + 1
    assert j6.where("matched").count() > 0 and j6.where("NOT matched AND id >= 0").count() > 0
    assert run("o3_exact_sample").count() == sum(round(r["count"] * 0.1) for r in halos.groupBy(halos.k % 4).count().collect())
    doubled = halos.where("k % 401 = 5 AND k % 29 <> 0").select("k").distinct()
    assert run("j5_match_by_position").join(doubled, doubled.k == Q.F.col("a_key")).where("a_key = b_key").count() == doubled.count() > 0
