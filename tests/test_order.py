"""What depends on an order - greedy duplicates, registry assignment - against plain loops over all rows."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewatch.operators import dedup, registry

NOW = datetime(2024, 6, 1)


def unit(v):
    return v / np.linalg.norm(v)


def loop_greedy(rows, theta, hours):
    out = {}
    for c in {r[0] for r in rows}:
        kept = []
        for _, i, v, at in sorted((r for r in rows if r[0] == c), key=lambda r: (r[3] is not None, r[3] or NOW, r[1])):
            near = (k for k, w, b in kept if round(float(np.dot(v, w)), 9) >= theta and (at is None or b is None or abs((at - b).total_seconds()) <= hours * 3600))
            out[c, i] = next(near, None)
            if out[c, i] is None:
                kept.append((i, v, at))
    return out


@pytest.mark.parametrize("block", [7, 40, 4096])
def test_greedy_by_waves(spark, block):
    rng = np.random.default_rng(block)
    centres = [unit(rng.normal(size=8)) for _ in range(6)]
    rows = []
    for k in range(150):
        v = unit(centres[k % 6] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2]))
        at = None if k % 11 == 0 else NOW + timedelta(hours=float(rng.integers(0, 300)))
        rows.append((None if k % 5 == 0 else 1, f"a{k:03}", v.round(6), at))
    rows += [(2, f"copy{k}", centres[0], NOW + timedelta(minutes=k)) for k in range(60)] + [(3, "alone", centres[1], None)]
    df = spark.createDataFrame([(c, i, v.tolist(), at) for c, i, v, at in rows], "cluster_id int, article_id string, embedding array<double>, published_at timestamp")
    found = {(r.cluster, r.id): r.duplicate_of for r in dedup.greedy_duplicates(df.repartition(5), 0.95, 72, block=block).collect()}
    expected = loop_greedy(rows, 0.95, 72)
    assert found == expected and sum(v is not None for v in expected.values()) > 60 and sum(v is None for v in expected.values()) > 12
    assert dedup.greedy_duplicates(df.where("false"), block=block).count() == 0


def loop_assign(clusters, events, theta):
    now = {e: v for e, v, status in events if status not in ("closed", "rejected")}
    out = []
    for c, v, first in clusters:
        sims = sorted((-round(float(np.dot(v, w)), 9), e) for e, w in now.items())
        hit = sims and -sims[0][0] >= theta
        event = sims[0][1] if hit else hashlib.sha256(f"{c}|{first}".encode()).hexdigest()[:32]
        out.append((c, event, not hit))
        now[event] = v
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assignment_by_components(spark, seed):
    rng = np.random.default_rng(seed)
    centres = [unit(rng.normal(size=6)) for _ in range(5)]
    spread = lambda n, k: [unit(centres[rng.integers(k)] + rng.normal(size=6) * 0.25).round(6) for _ in range(n)]
    clusters = [(i, v, f"f{i}") for i, v in enumerate(spread(40, 5))]
    events = [(f"e{i:02}", v, "closed" if i % 9 == 0 else "enriched") for i, v in enumerate(spread(25, 3))]
    one = spark.createDataFrame([(c, v.tolist(), 3, f) for c, v, f in clusters], "cluster_id int, centroid array<double>, n int, first_id string")
    two = spark.createDataFrame([(e, v.tolist(), s) for e, v, s in events], "event_id string, centroid array<double>, status string")
    expected = loop_assign(clusters, events, 0.9)
    got = registry.assign(one.repartition(4), two, 0.9)
    assert [(g["cluster_id"], g["event_id"], g["is_new"]) for g in got] == expected
    events_met = [e for _, e, _ in expected]
    assert len(set(events_met)) < len(events_met) and any(n for *_, n in expected) and not all(n for *_, n in expected)
    assert registry.assign(one.where("false"), two) == [] and all(g["is_new"] for g in registry.assign(one, two.where("false"), 2.0))
