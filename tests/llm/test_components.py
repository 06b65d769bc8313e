from __future__ import annotations

import random

import pytest

from linkwright.llm import components


@pytest.mark.parametrize("few", [0, components.FEW])
def test_few_edges_take_one_round(spark, monkeypatch, few):
    rng, rounds = random.Random(3), []
    monkeypatch.setattr(components, "release", lambda *a, **b: rounds.append(1))
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7), (1 << 62, 3)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), few=few)
    assert sorted(map(tuple, got.collect())) == sorted((x, r) for x, r in least.items() if x != r)
    assert bool(rounds) == (few == 0)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([(5, 5)], "a long, b long")).collect() == []
