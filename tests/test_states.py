import pytest

from wordloom.operators import readouts as O


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def change(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", "false")

    yield change
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_kmeans_states_do_not_grow_with_the_session(spark, partitions):
    """Tasks of a fit, each of which reports to the driver, and the states themselves depend on the rows, not on shuffle partitions."""
    rows = [(i, h, ((i * 37) % 11) * 0.3 + ((i * 13) % 7) * 0.01 * h) for i in range(60) for h in range(3)]
    sc, tasks, found = spark.sparkContext, [], []
    for n in (3, 24):
        partitions(n)
        sc.setJobGroup(f"states-{n}", "states")
        states, _ = O.future_states(spark.createDataFrame(rows, "sample long, h int, level double"), 3, 4)
        found.append([tuple(r) for r in states.orderBy("sample").collect()])
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"states-{n}")]
        tasks.append(sum(sc.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds if sc.statusTracker().getStageInfo(s)) / len(jobs))
    sc.setJobGroup("", "")
    assert found[0] == found[1] and len(found[0]) == 60
    assert tasks[1] < tasks[0] + 6
