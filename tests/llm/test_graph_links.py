"""Components of links: what the tasks thin out, the one task for few links, and the rounds of joins for many."""

import random

import pytest
from tallywood.llm import graph as G


def plain(links):
    top = {x: x for link in links for x in link if link[0] != link[1]}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if a != b and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                moved = True
    return top


@pytest.mark.parametrize("few", [G.SMALL_LINKS, 5])
def test_random_links_and_a_chain(spark, few):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (9000, 9000)]
    df = spark.createDataFrame(links * 2, "a long, b long").repartition(5)
    got = G.components(df, few).collect()
    assert {r.node: r.component for r in got} == plain(links) and len(got) == len(plain(links))
    assert not G.components(df.limit(0), few).collect()


def test_few_links_take_few_jobs(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(2000)], "a long, b long").repartition(8)
    jobs = spark._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    assert {r.component for r in G.components(df).collect()} == {0}
    assert jobs() - before <= 8  # each round of joins takes several
