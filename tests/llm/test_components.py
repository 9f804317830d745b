"""Components of edge tables: right whatever the tasks hold, and few shuffles a round."""

import random

import pytest

from landmosaic.llm import components, simhash


def by_hand(edges):
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


@pytest.mark.parametrize("chunk", [components.CHUNK, 1])
def test_components_whatever_the_tasks_hold(spark, monkeypatch, chunk):
    """Paths, stars about their largest node, repeats, loops and unlike sparse parts; also where tasks contract nothing."""
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(3)
    name = rng.sample(range(-500, 500), 400)
    edges = [(name[k], name[k + 1]) for k in range(40)] + [(1000, name[k]) for k in range(50, 90)] + [(7000, 7000)]
    edges += [(name[rng.randrange(100, 400)], name[rng.randrange(100, 400)]) for _ in range(220)]
    edges += edges[:60] + [(b, a) for a, b in edges[30:90]]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    found = components.components(df).collect()
    assert {r.node: r.root for r in found} == by_hand(edges) and len(found) == len(by_hand(edges))
    nulls = spark.createDataFrame([(None, 1), (2, None), (None, None), (5, 4)], "a long, b long")
    assert sorted(tuple(r) for r in components.components(nulls).collect()) == [(4, 4), (5, 4)]


def test_a_round_is_two_shuffles(spark, monkeypatch):
    """Each shuffle of a few rows is still a task for every partition, with its files and its events."""
    shuffles, cut = [], components.cut

    def counted(df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return cut(df)

    monkeypatch.setattr(components, "cut", counted)
    edges = [(k, k + 1) for k in range(30)]
    assert {r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5).checkpoint()).collect()} == {0}
    assert len(shuffles) > 1 and max(shuffles) <= 2


def test_rounds_of_fingerprints_are_searched_once(spark, monkeypatch):
    searched, links = [], simhash.links

    def counted(distinct):
        searched.append(distinct.count())
        return links(distinct)

    monkeypatch.setattr(simhash, "links", counted)
    base = " ".join(f"w{k}" for k in range(60))
    texts = [base, base + " x", "a b c d e f", "", "a b c d e g h i j k"]
    got = {r.id: r.group for r in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4} and len(searched) == 1 and searched[0] > len(texts)
