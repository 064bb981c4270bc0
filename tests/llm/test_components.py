import random

from topicspark.llm.components import components
from topicspark.llm.stages import Steps


def by_hand(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    for links in ([(i, i + 1) for i in range(60)], [(100 - i, 99 - i) for i in range(40)] + [(500, i) for i in range(200, 230)],
                  [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)]):
        links = [(a, b) for a, b in links if a != b]
        df = spark.createDataFrame(links, "a bigint, b bigint")
        got = components(Steps(spark, "test"), df, "t")
        assert {r["node"]: r["root"] for r in got.collect()} == by_hand(links)
        first, second = links[: len(links) // 2], links[len(links) // 2:]
        steps = Steps(spark, "test")
        known = components(steps, spark.createDataFrame(first, "a bigint, b bigint"), "one")
        got = components(steps, spark.createDataFrame(second, "a bigint, b bigint"), "two", known)
        assert {r["node"]: r["root"] for r in got.collect()} == by_hand(links)


def test_no_links(spark):
    assert components(Steps(spark, "test"), spark.createDataFrame([], "a bigint, b bigint"), "t").count() == 0
