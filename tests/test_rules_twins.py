"""Every detector fires on its positive snippet and stays silent on its negative one."""

from lodegrid.plans.snippets import TWINS
from lodegrid.rules import detectors, evaluate, rules_for


def test_profile_sizes():
    assert [len(detectors(p)) for p in ("deep", "ultra-deep", "ultra-deep-v2")] == [57, 68, 120]
    assert detectors("no-such-profile") == detectors("deep")


def test_twins(spark):
    rows = []
    for i, (pos, neg) in enumerate(TWINS.values()):
        rows += [(2 * i, "ethereum", "p.sol", 0, pos), (2 * i + 1, "ethereum", "n.sol", 0, neg)]
    files = spark.createDataFrame(rows, "target_id long, chain string, path string, pos int, raw string").repartition(16)
    hits = evaluate(files, rules_for("ultra-deep-v2")).select("target_id", "detector").distinct().collect()
    got = {(h.target_id, h.detector) for h in hits}
    names = list(TWINS)
    silent = [d for i, d in enumerate(names) if (2 * i, d) not in got]
    noisy = [d for i, d in enumerate(names) if (2 * i + 1, d) in got]
    assert silent == []
    assert noisy == []
