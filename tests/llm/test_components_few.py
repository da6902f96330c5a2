"""Components by one task and by steps are the same."""

from __future__ import annotations

import random

import pytest

from revlake.llm import components


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_either_way(spark, monkeypatch, few):
    steps = []
    stage = components.stage
    monkeypatch.setattr(components, "FEW", few, raising=False)
    monkeypatch.setattr(components, "stage", lambda df, label: steps.append(label) or stage(df, label))
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(None, 1), (100, 101), (101, 102), (102, 103)]
    up = list(range(200))
    for _ in range(200):
        for u, v in edges:
            if u is not None:
                up[u] = up[v] = min(up[u], up[v])
    want = {x: up[x] for e in edges if e[0] is not None and e[0] != e[1] for x in e}
    assert {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert few == 0 or steps == ["edges"]
