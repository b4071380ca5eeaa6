"""Texts that arrive as a stream: links against the components of a plain loop, restarts, late rows, forgetting."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from echolode.config import Windows
from echolode.streaming import arrivals

DAY, WINDOWS = 86400, Windows(2, 2, 1)


def put(folder, number, rows):
    """One file of (id, text, day); ids may repeat, any of the three may be null."""
    at = [None if d is None else datetime.fromtimestamp(d * DAY, timezone.utc) for _, _, d in rows]
    table = pa.table({"name": pa.array([n for n, _, _ in rows], pa.string()), "text": pa.array([t for _, t, _ in rows], pa.string()), "at": pa.array(at, pa.timestamp("us", "UTC")), "path": pa.array(["clash"] * len(rows), pa.string())})
    folder.mkdir(exist_ok=True)
    pq.write_table(table, folder / f"{number:03}.parquet")


def run(spark, tmp_path, horizon=5, late=3):
    d = spark.readStream.schema("name string, text string, at timestamp, path string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = arrivals.watch(d, "name", "text", "at", str(tmp_path / "out"), str(tmp_path / "state"), WINDOWS, timedelta(days=horizon), timedelta(days=late))
    q.awaitTermination()
    return q


def found(spark, tmp_path):
    rows = spark.read.schema(arrivals.LINK).parquet(str(tmp_path / "out"))
    return rows.collect(), groups((r.a_path, r.b_path) for r in rows.collect())


def groups(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[top(a)] = top(b)
    out = defaultdict(set)
    for x in root:
        out[top(x)].add(x)
    return sorted(map(sorted, out.values()))


def plain(rows, horizon):
    """Components over all pairs of equal windows no further apart than the horizon."""
    seen = [(w, n or "", d) for n, t, d in rows if d is not None for w in cut(t or "")]
    return groups((a, b) for x, a, d in seen for y, b, e in seen if x == y and a != b and abs(d - e) <= horizon)


def cut(text):
    lines = text.split("\n")
    return {"\n".join(lines[k : k + 2]) for k in range(0, len(lines), 2) if any(x.strip() for x in lines[k : k + 2])}


def some(seed, n, days):
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(4)) for _ in range(12)]
    return [(f"t{k}", rng.choice(texts), rng.choice(days)) for k in range(n)]


def test_same_as_a_batch_and_restarts(spark, tmp_path):
    rows = some(3, 40, range(30))
    rows.sort(key=lambda r: r[2])
    for k in range(2):
        put(tmp_path / "in", k, rows[k * 10 : k * 10 + 10])
    run(spark, tmp_path)
    before, got = found(spark, tmp_path)
    assert got == plain(rows[:20], 5)
    run(spark, tmp_path)  # nothing new: nothing is said again
    assert len(found(spark, tmp_path)[0]) == len(before)
    for k in range(2, 4):
        put(tmp_path / "in", k, rows[k * 10 : k * 10 + 10])
    run(spark, tmp_path)  # a new query over the same state
    assert found(spark, tmp_path)[1] == plain(rows, 5) != []


def test_late_rows_and_forgetting(spark, tmp_path):
    same = "one\ntwo"
    put(tmp_path / "in", 0, [("a", same, 100), ("x", "else\nwhere", 100)])
    put(tmp_path / "in", 1, [("b", same, 98), ("gone", "else\nwhere", 130)])  # b is out of order, but not late
    put(tmp_path / "in", 2, [("late", same, 101), ("c", same, 131)])  # the watermark is at day 127
    put(tmp_path / "in", 3, [("d", same, 133)])
    q = run(spark, tmp_path)
    assert found(spark, tmp_path)[1] == [["a", "b"], ["c", "d"]]
    held = [p.stateOperators[0] for p in q.recentProgress]
    assert sum(s.numRowsDroppedByWatermark for s in held) == 1
    assert held[-1].numRowsTotal < 20


def test_odd_rows(spark, tmp_path):
    long = "\n".join(f"line {k}" for k in range(20001))
    rows = [("a", long, 1), ("b", long, 1), ("a", long, 1), (None, "p\nq", 1), ("n", "p\nq", 2), ("none", None, 1), ("empty", "", 1), ("timeless", "p\nq", None)]
    put(tmp_path / "in", 0, rows)
    put(tmp_path / "in", 1, [])
    run(spark, tmp_path)
    rows_out, got = found(spark, tmp_path)
    assert got == [["", "n"], ["a", "b"]]
    assert len(rows_out) <= 1 + 2 * 10001  # no pairs of all


@pytest.mark.parametrize("seed", range(30))
def test_stretches_are_put_together_in_any_order(seed):
    rng = random.Random(seed)
    seen = [(rng.randrange(60), f"p{k}", 1, 2) for k in range(rng.randrange(1, 12))]
    kept, links = [], []
    order = rng.sample(seen, len(seen))
    while order:
        part, order = order[:3], order[3:]
        own, new = arrivals.joined([x + x for x in part], 5)
        kept, more = arrivals.joined(kept + own, 5)
        links += new + more
    assert groups((a[0], a[3]) for a in links) == groups((a[1], b[1]) for a in seen for b in seen if a != b and abs(a[0] - b[0]) <= 5)
    assert len(links) < len(seen)


def test_a_bucket_is_read_and_written_once():
    """Each window had calls to the store of its own; a batch's windows of a bucket share them, and so do those that end."""
    held, calls = [], []

    class Store:
        def getListState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return iter(list(held))

        def put(self, rows):
            calls.append("put")
            held[:] = rows

        def clear(self):
            calls.append("clear")
            held.clear()

        def registerTimer(self, at):
            calls.append(at)

        def deleteTimer(self, at):
            calls.append(-at)

        def getExpiryTimeInMs(self):
            return 12

        def getCurrentWatermarkInMs(self):
            return 40

    names = [x.split()[0] for x in arrivals.SPAN.split(", ")]
    row = lambda own, at, path: {"own": own} | dict(zip(names, (at, path, 1, 2) * 2, strict=True))
    s = arrivals.Stretches(5)
    s.init(Store())
    assert list(s.handleInputRows(("1",), [row(f"w{k}", 7 + k % 3, "a") for k in range(100)], None)) == []
    assert calls == ["get", 12, "put"] and len(held) == 100
    links = list(s.handleInputRows(("1",), [row("w0", 11, "b"), row("w1", 90, "c")], None))
    assert [(x.a_path, x.b_path) for x in links] == [("a", "b")] and len(held) == 101
    list(s.handleExpiredTimer(("1",), Store(), Store()))
    assert [(x[0], x[5]) for x in held] == [("w1", 90)] and calls[-2:] == [95, "put"]
