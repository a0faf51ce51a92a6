import random

import pytest

from leafmill.llm import common, neardup


@pytest.fixture
def many_partitions(spark):
    """Every exchange has 64 partitions, empty ones too."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def tasks_of(spark, work):
    """What ``work`` returns, and how many tasks its stages had."""
    sc, name = spark.sparkContext, f"few-tasks-{random.random()}"
    sc.setJobGroup(name, name)
    try:
        out = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    status = sc.statusTracker()
    stages = {s for job in status.getJobIdsForGroup(name) for s in status.getJobInfo(job).stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))


def test_components_of_few_edges_take_few_tasks(spark, many_partitions, monkeypatch):
    """Edges of more than one part, in rounds: the driver keeps a record of every task."""
    monkeypatch.setattr(common, "COMPACT_ROWS", 60)
    rng = random.Random(3)
    names = rng.sample(range(1000), 90)
    paths = [names[k : k + 30] for k in range(0, 90, 30)]
    edges = [(a, b) for p in paths for a, b in zip(p, p[1:])]
    labels, tasks = tasks_of(spark, lambda: neardup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert sorted(map(tuple, labels)) == sorted((v, min(p)) for p in paths for v in p)
    assert tasks < 500


def test_a_written_table_is_counted_by_a_task_a_core(spark, many_partitions):
    df = common.cut(spark.range(1000).repartition(64))
    assert df.rdd.getNumPartitions() == 64
    n, tasks = tasks_of(spark, lambda: common.counted(df))
    assert n == 1000 and tasks <= spark.sparkContext.defaultParallelism + 1
    _, tasks = tasks_of(spark, lambda: common.small(df))
    assert tasks <= spark.sparkContext.defaultParallelism + 1


def test_rounds_over_small_parts_give_all_links(spark, many_partitions, monkeypatch):
    """Buckets that hold several components, so that rounds follow, over tables of several parts."""
    monkeypatch.setattr(common, "COMPACT_ROWS", 500)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=120)
    texts = []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(120), k % 7):
            own[at] = f"x{k}y{at}"
        texts.append((k, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = neardup.near_duplicates(docs, 85).collect()
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in texts for w in [t.split()]}
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    assert {r.doc_id: r.component_id for r in rows} == label
