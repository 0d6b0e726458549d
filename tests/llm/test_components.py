"""Components against brute force, and how much is planned for them."""

import random

from folioforge.llm import components


def brute(edges):
    top = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(top[a], top[b])
            changed |= top[a] != low or top[b] != low
            top[a] = top[b] = low
    return top


def test_components_of_chains_stars_and_rings(spark):
    r = random.Random(5)
    names = [r.randrange(-(2**62), 2**62) for _ in range(400)]
    edges = [(names[i], names[i + 1]) for i in range(60)] + [(names[100], names[i]) for i in range(101, 180)]
    edges += [(names[200 + i], names[200 + (i + 1) % 30]) for i in range(30)] + [(names[i], names[r.randrange(300, 400)]) for i in range(300, 400)]
    table = spark.createDataFrame([*edges, *edges[:5], (names[0], names[0])], "a long, b long")
    got = components.components(table).collect()
    assert {x.node: x.component for x in got} == brute(edges) and len(got) == len(brute(edges))
    assert components.components(table.where("false")).isEmpty()


def test_stars_are_told_from_other_links(spark):
    told = lambda edges: components._stars(spark.createDataFrame(edges, "a long, b long"))
    assert told([(2, 1), (3, 1), (5, 4)]) and not told([(2, 1), (3, 2)]) and not told([(3, 1), (3, 2)])


def test_a_star_takes_one_round_of_light_plans(spark, monkeypatch):
    """A table of the links, one of each half round, and no more round to see that nothing changes; none plans more than two groupings."""
    seen, plain = [], components.written
    count = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Aggregate")
    monkeypatch.setattr(components, "written", lambda df, name: seen.append(count(df)) or plain(df, name))
    found = components.components(spark.createDataFrame([(1, i) for i in range(2, 50)], "a long, b long"))
    assert found.count() == 49 and len(seen) == 3 and max(seen) <= 4
