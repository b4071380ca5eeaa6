"""Components kept through changes, against components worked out anew."""

import random

from echolode.operators.components import connected_components
from echolode.operators.upkeep import Clusters

EDGE = "src string, dst string"


def plain(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


def test_upkeep_through_changes(spark, tmp_path):
    rng = random.Random(12)
    name = lambda: f"n{rng.randrange(40):02d}"
    frame = lambda rows: spark.createDataFrame(list(rows), EDGE)
    kept, now = Clusters(spark, str(tmp_path / "c")), set()
    kept.store.most = 4
    assert kept.labels().count() == 0
    for step in range(7):
        added = {(name(), name()) for _ in range(rng.choice([0, 6, 14]))}
        removed = set(rng.sample(sorted(now), min(len(now), rng.choice([0, 3, 9])))) | {("not", "there")}
        both = {tuple(sorted(e)) for e in added}
        now = (now - {tuple(sorted(e)) for e in removed}) | both
        got = kept.update(frame([*added, *list(added)[:2], (None, "n01"), ("n02", None)]), frame([(b, a) for a, b in removed]))
        assert {r.node: r.component for r in got.collect()} == plain(now), step
        assert {tuple(r) for r in kept.edges().collect()} == now
    assert {r.node: r.component for r in kept.sync(frame([("a", "b"), ("b", "b")])).collect()} == {"a": "a", "b": "a"}
    again = Clusters(spark, str(tmp_path / "c"))
    assert {r.node: r.component for r in again.labels().collect()} == {"a": "a", "b": "a"}
    version = again.store.current().version
    again.sync(frame([("b", "a"), ("b", "b")]))
    assert again.store.current().version == version  # nothing changed
    assert again.sync(frame([("x", "y")]).limit(0)).count() == 0
    assert connected_components(frame([("p", "q")])).count() == 2
