import zlib
from collections import defaultdict

import numpy as np

from tallyspark.llm import sharding


def check(rows, texts, shards):
    slots, sizes, group = defaultdict(list), defaultdict(int), defaultdict(set)
    for x in rows:
        slots[x.shard].append(x.slot)
        sizes[x.shard] += x.size
        group[x.text_crc32, x.size].add(x.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in group.values())
    assert sorted((x.doc_id or -1, x.size, x.text_crc32) for x in rows) == sorted(
        (i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    return [sizes[k] for k in range(shards)]


def test_bytes_are_near_equal(docs, clashing, prose, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 3)
    texts = [(i, prose(i, 1 + i * 7 % 60)) for i in range(400)]
    same = texts[3][1]
    texts += [(1000, same), (1000, same), (None, None), (None, ""), (3, same)]
    table = clashing(docs([t for _, t in texts], ids=[i for i, _ in texts])).repartition(4)
    sizes = check(sharding.shard(table, 6, block=20).collect(), texts, 6)
    assert max(sizes) - min(sizes) <= 250  # blocks of 20 groups, three at a time
    sizes = check(sharding.shard(table, 6).collect(), texts, 6)
    assert max(sizes) - min(sizes) <= 5
    assert sharding.shard(table.limit(0), 6).count() == 0


def test_a_large_group_stays_whole(docs, prose):
    texts = [(i, "same " * 50) for i in range(60)] + [(100 + i, prose(i, 20)) for i in range(90)]
    rows = sharding.shard(docs([t for _, t in texts], ids=[i for i, _ in texts]), 4).collect()
    sizes = sorted(check(rows, texts, 4))
    assert max(sizes[:3]) - min(sizes[:3]) <= 100 and sizes[3] >= 60 * 258


def test_differencing_beats_greedy():
    """The textbook case: differencing finds two equal halves where largest-first does not."""
    sizes = np.zeros((5, 2), "i8")
    sizes[:, 0] = [8, 7, 6, 5, 4]
    parts = sharding.difference(sizes)[:, 0]
    sums = np.bincount(parts, sizes[:, 0])
    assert abs(sums[0] - sums[1]) == 2
    r = np.random.default_rng(1)
    sizes = np.zeros((500, 24), "i8")
    sizes[:, 0] = r.integers(1, 10**6, 500)
    sums = np.bincount(sharding.difference(sizes)[:, 0], sizes[:, 0], 24)
    greedy = np.zeros(24)
    for s in sorted(sizes[:, 0], reverse=True):
        greedy[greedy.argmin()] += s
    assert np.ptp(sums) < np.ptp(greedy)


def test_partial_partitions_keep_their_sums():
    r = np.random.default_rng(2)
    partials = r.integers(0, 1000, (30, 8))
    to = sharding.difference(partials)
    assert all(sorted(row) == list(range(8)) for row in to.tolist())
    sums = np.bincount(to.ravel(), partials.ravel(), 8)
    assert np.ptp(sums) < 100
