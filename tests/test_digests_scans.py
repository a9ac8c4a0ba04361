"""Digest trees and scans as a stream find what a comparison of whole snapshots finds."""

import glob
import os

import pytest

from millrace.plans import digests as G
from millrace.plans.views import changed
from millrace.streaming import scans as Q

ROWS = "path string, hash string"


def table(spark, rows):
    return spark.createDataFrame(list(rows), ROWS)


def plain(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def base(n):
    return {f"wiki/{'design/' if i % 3 else ''}page-{i}.md": f"h{i}" for i in range(n)}


def test_trees_find_all_changes(spark, tmp_path):
    old = base(4000)
    new = {p: h for p, h in old.items() if not p.endswith("77.md")} | {f"wiki/new-{i}.md": "n" for i in range(5)}
    new["wiki/page-0.md"] = None
    a, b = table(spark, old.items()), table(spark, new.items())
    G.write(a, str(tmp_path / "a"))
    G.write(b, str(tmp_path / "b"))
    x, y = G.Snapshot.read(spark, str(tmp_path / "a")), G.Snapshot.read(spark, str(tmp_path / "b"))
    want = plain(changed(a, b), "path", "change")
    assert len(want) == 46
    for p, q in ((x, y), (x, G.Snapshot.of(b)), (G.Snapshot.of(a), y)):
        assert plain(G.changes(p, q), "path", "change") == want
    levels = G.differing(x, y)
    assert levels[0] == [""] and [len(v) for v in levels[1:]] == sorted(len(v) for v in levels[1:]) and len(levels[-1]) <= 46
    assert plain(G.tree(a), "level", "node", "n", "x", "y") == plain(x.nodes, "level", "node", "n", "x", "y")


def test_equal_and_empty_snapshots(spark, tmp_path):
    a = table(spark, base(300).items())
    G.write(a.repartition(7), str(tmp_path / "a"))
    x = G.Snapshot.read(spark, str(tmp_path / "a"))
    assert G.differing(x, G.Snapshot.of(a.orderBy("hash"))) == [[]] and G.changes(x, G.Snapshot.of(a)).count() == 0
    none = table(spark, [(None, "h")])  # without a path
    assert G.changes(G.Snapshot.of(none), G.Snapshot.of(none)).count() == 0
    assert plain(G.changes(x, G.Snapshot.of(none)).groupBy("change").count(), "change", "count") == [("removed", 300)]
    with pytest.raises(ValueError):
        G.differing(x, G.Snapshot.of(a, 3))


def test_many_leaves_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "NAMED", 2)
    a = base(500)
    b = {p: h + "x" if i % 20 == 0 else h for i, (p, h) in enumerate(a.items())}
    G.write(table(spark, a.items()), str(tmp_path / "a"))
    got = G.changes(G.Snapshot.read(spark, str(tmp_path / "a")), G.Snapshot.of(table(spark, b.items())))
    assert plain(got, "path", "change") == sorted((p, "changed") for i, p in enumerate(a) if i % 20 == 0)


def test_only_differing_ranges_are_read(spark, tmp_path):
    old = base(3000)
    new = {**old, "wiki/page-9.md": "other"}
    for name, rows in (("a", old), ("b", new)):
        G.write(table(spark, rows.items()), str(tmp_path / name))
    x, y = (G.Snapshot.read(spark, str(tmp_path / n)) for n in "ab")
    levels = G.differing(x, y)
    assert [len(v) for v in levels] == [1] * 5
    files = x.under(levels[-1]).inputFiles()
    part = x.under(levels[-1])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(key" in plan and files
    scan = part._jdf.queryExecution().executedPlan()
    part.collect()
    leaf = scan.collectLeaves().apply(0)
    assert leaf.metrics().apply("numFiles").value() == 1
    assert part.count() <= 3 < 3000


def scans_of():
    one = base(40)
    two = {p: (h + "x" if p.endswith("3.md") else h) for p, h in one.items() if not p.endswith("1.md")} | {"wiki/late.md": "l"}
    three = {p: h for p, h in one.items() if not p.endswith("2.md")}
    return [one, two, three]


def wanted(spark, scans):
    out, last = [], {}
    for k, now in enumerate(scans, 1):
        out += [(*r, k) for r in plain(changed(table(spark, last.items()), table(spark, now.items())), "path", "change")]
        last = now
    return sorted(out)


def test_scans_in_batches_of_their_own_with_replay(spark, tmp_path):
    folder, target, state = (str(tmp_path / n) for n in ("scans", "events", "state"))
    scans = scans_of()
    for k, rows in enumerate(scans, 1):
        Q.publish(table(spark, rows.items()).coalesce(1), folder, k)
        got = plain(Q.follow(spark, folder, target, state), "path", "change", "scan")
        assert got == wanted(spark, scans[:k])
    # Nothing new: nothing comes out twice.
    assert plain(Q.follow(spark, folder, target, state), "path", "change", "scan") == got
    # The last batches are run again, as after a failure before their commit.
    for f in sorted(glob.glob(f"{state}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))[-1:]:
        os.remove(f)
        if os.path.exists(f"{state}/commits/.{os.path.basename(f)}.crc"):
            os.remove(f"{state}/commits/.{os.path.basename(f)}.crc")
    assert plain(Q.follow(spark, folder, target, state), "path", "change", "scan") == got
    with pytest.raises(ValueError):
        Q.publish(table(spark, []), folder, 2)


@pytest.mark.parametrize("files", [None, 1])
def test_batches_dont_change_events(spark, tmp_path, files):
    """All scans in one batch, and each scan in several."""
    scans = scans_of()
    for k, rows in enumerate(scans, 1):
        Q.publish(table(spark, rows.items()).coalesce(2), str(tmp_path / "scans"), k)
    got = Q.follow(spark, str(tmp_path / "scans"), str(tmp_path / "events"), str(tmp_path / "state"), files)
    assert plain(got, "path", "change", "scan") == wanted(spark, scans)
