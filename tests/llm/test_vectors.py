"""Operators on vectors against brute force."""

import hashlib
import math

import numpy as np
import pytest

from tallyspark.llm import capfilters, vafile, vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids=None, labels=None):
    n = len(vectors)
    rows = list(zip(range(n) if ids is None else ids,
                    [None if v is None else [None if x is None else float(np.float32(x))
                                             for x in v] for v in vectors],
                    [k % 3 for k in range(n)] if labels is None else labels))
    return spark.createDataFrame(rows, SCHEMA)


def random_vectors(n, dimensions, seed, groups=5):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, dimensions))
    v = centres[r.integers(0, groups, n)] + 0.6 * r.standard_normal((n, dimensions))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("f4").tolist()


BAD = [None, [], [1.0] * 63, [math.nan] + [0.0] * 63, [math.inf] + [0.0] * 63, [None] * 64]


def floors(vectors, scale):
    return np.floor(np.array(vectors, "f4").astype("f8") * scale).astype("i8")


def plain_clusters(x, ids, count, rounds):
    order = sorted(range(len(x)), key=lambda i: (
        hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), x[i].tolist()))[:count]
    c = x[order]
    for r in range(rounds + 1):
        far = ((x[:, None] - c[None]) ** 2).sum(-1)
        a = far.argmin(1)
        if r < rounds:
            c = np.array([x[a == k].sum(0) // (a == k).sum() if (a == k).any() else c[k]
                          for k in range(len(c))])
    return a, far.min(1), c


@pytest.mark.parametrize("bits,count", [(6, 40), (2, 7)])
def test_clusters_equal_plain_kmeans(spark, clashing, bits, count):
    v = random_vectors(300, 64, 1)
    v += v[:30] + [[0.0] * 64] * 5 + [[-3.0] * 64]
    ids = list(range(len(v) - 3)) + [5, 5, 6]  # repeated ids of other vectors
    df = clashing(table(spark, v + BAD, ids + [900 + k for k in range(len(BAD))]))
    got = vafile.clusters(df, count=count, bits=bits)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                           "centroid_sha256"]
    a, far, c = plain_clusters(floors(v, 256), ids, count, 5)
    want = sorted((i, int(k), int(d), int(far[a == k].sum()), int(far.sum()),
                   hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest())
                  for i, k, d in zip(ids, a, far))
    assert sorted(map(tuple, got.collect())) == want


def test_cells_keep_the_nearest_and_drop_others():
    r = np.random.default_rng(3)
    x = np.floor(r.standard_normal((500, 16)) * 40).astype("i8")
    cuts = np.quantile(x, np.arange(1, 64) / 64, axis=0).astype("i8").T
    grid = vafile.Grid(cuts, x.min(0), x.max(0), 6)
    codes = grid.encode(x)
    assert codes.shape == (500, grid.width) == (500, 12)
    middle, half = grid.look_up(codes)
    assert (np.abs(x - middle) <= half).all()
    c = x[:9]
    may = vafile.overlapping(middle, half, c)
    assert may[np.arange(500), ((x[:, None] - c) ** 2).sum(-1).argmin(1)].all()
    assert may.mean() < 0.3


def test_settled_vectors_are_not_fetched(spark):
    """Two tight groups: after the first round no vector moves, and cells settle most; the rest
    lie in cells that span the gap."""
    r = np.random.default_rng(8)
    x = np.concatenate([100 + r.integers(0, 3, (40, 4)), -100 + r.integers(0, 3, (40, 4))])
    vectors = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)],
                                    "rid long, x array<long>")
    vafile.ship(spark)
    grid = vafile.grid_of(vectors, 3)
    cells = spark.createDataFrame([(i, bytearray(c.tobytes()))
                                   for i, c in enumerate(grid.encode(x))],
                                  "rid long, code binary")
    near, far = np.array([[100] * 4, [-100] * 4]), np.array([[90] * 4, [-90] * 4])
    assert vafile.asked(cells, grid, near, far).count() < 30
    assert vafile.asked(cells, grid, None, far).count() == 80


def test_few_and_no_vectors(spark):
    v = random_vectors(3, 64, 4)
    rows = vafile.clusters(table(spark, v, [None, 1, 2])).collect()
    assert {r.cluster for r in rows} == {0, 1, 2} and {r.distance for r in rows} == {0}
    assert next(r.cluster for r in rows if r.vec_id is None) == 2
    empty = table(spark, v).limit(0)
    for found in (vafile.clusters(empty), vectorcodes.codes(empty), capfilters.groups(empty),
                  vafile.clusters(table(spark, BAD)), vectorcodes.codes(table(spark, BAD[:2]))):
        assert found.count() == 0
    huge = table(spark, [[1e7] * 64])
    with pytest.raises(Exception, match="beyond"):
        vafile.clusters(huge).collect()


def plain_codes(x, ids, entries, rounds, parts=8):
    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0, x[i].tolist()))
    x = x.reshape(len(x), parts, -1)
    books = x[order[:entries]].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        far = np.stack([((x[:, p, None] - books[p]) ** 2).sum(-1) for p in range(parts)], 1)
        code = far.argmin(-1)
        if r < rounds:
            for p in range(parts):
                for k in range(books.shape[1]):
                    if (at := code[:, p] == k).any():
                        books[p, k] = x[at, p].sum(0) // at.sum()
    return code, far.min(-1).sum(1), books


@pytest.mark.parametrize("entries,rounds", [(16, 6), (3, 2), (1, 1), (4, 0)])
def test_codes_equal_plain_training(spark, clashing, entries, rounds):
    v = random_vectors(250, 64, 2)
    v += v[:20] + [[0.0] * 64] * 4 + [[-0.5] * 64]
    ids = list(range(len(v) - 2)) + [3, None]
    labels = [None if k % 7 == 0 else k % 4 for k in range(len(v))]
    df = clashing(table(spark, v + BAD[:2] + BAD[3:] + [[1.0, 2.0]], [*ids, *range(900, 906)],
                        labels + [1] * 6))
    got = vectorcodes.codes(df, entries=entries, rounds=rounds)
    code, error, books = plain_codes(floors(v, 4096), ids, entries, rounds)
    sums = {}
    for at, e in zip(labels, error):
        sums[at] = sums.get(at, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1))).encode()).hexdigest()
    want = [(i, bytes(c.astype("u1")).hex(), int(e), sums[at], digest)
            for i, c, e, at in zip(ids, code, error, labels)]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_net_displacement_is_tighter_than_drifts():
    """An entry that comes back has moved by nothing, whatever way it went."""
    start = np.zeros((1, 2, 4), "i8")
    start[0, 1] = 100
    history = vectorcodes.History(start)
    for step in (30, 0, 30, 0):
        book = start.copy()
        book[0, 0] += step
        history.books.append(book)
    assert history.moved()[0, 0, 0] == 0 and history.moved()[1, 0, 0] == 60
    drift = sum(np.linalg.norm((b - a)[0, 0]) for a, b in zip(history.books, history.books[1:]))
    assert drift == 240
    x = np.array([[[20, 20, 20, 20]]])
    code, own, far = vectorcodes.rescan(x[:, 0], start[0])
    bounds = vectorcodes.Bounds([vectorcodes.blobs(code[:, None])]
                                + [vectorcodes.blobs(np.zeros((1, 1), "u1"))] * 2
                                + [vectorcodes.lists(own[:, None]),
                                   vectorcodes.lists(far[:, None])], 1)
    assert not bounds.unsettled(history.moved(), history.others()).any()
    assert np.sqrt(own[0]) + drift > np.sqrt(far[0])  # the accumulated bound would rescan


def test_bounds_settle_rows(spark):
    """Bounds settle ever more parts, and what they settle is right."""
    v = random_vectors(400, 64, 6, groups=4)
    x = floors(v, 4096).reshape(400, 8, 8)
    history = vectorcodes.History(x[:16].transpose(1, 0, 2).copy())
    shares, bounds = [], None
    for _ in range(6):
        if bounds is None:
            found = [vectorcodes.rescan(x[:, p], history.books[0][p]) for p in range(8)]
            code, own, far = (np.column_stack([f[k] for f in found]) for k in range(3))
            zero = vectorcodes.blobs(np.zeros_like(code))
            bounds = vectorcodes.Bounds([vectorcodes.blobs(code), zero, zero,
                                         vectorcodes.lists(own), vectorcodes.lists(far)], 8)
        else:
            open_ = bounds.unsettled(history.moved(), history.others())
            shares.append(open_.mean())
            vectorcodes.refresh(x, bounds, history, open_)
        book = history.books[-1].copy()
        for p in range(8):
            exact = ((x[:, p, None] - book[p]) ** 2).sum(-1)
            assert (exact.argmin(1) == bounds.code[:, p]).all()
        for p in range(8):
            for k in range(16):
                if (at := bounds.code[:, p] == k).any():
                    book[p, k] = x[at, p].sum(0) // at.sum()
        history.books.append(book)
    assert shares[-1] < 0.7 * shares[0]


def plain_links(vectors, cosine=0.95):
    n = len(vectors)
    links, least = np.zeros(n, int), list(range(n))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)
              and any(v) for v in vectors]
    unit = [np.array(v, "f4").astype("f8") / np.linalg.norm(np.array(v, "f4").astype("f8"))
            if ok else None for v, ok in zip(vectors, usable)]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and len(unit[i]) == len(unit[j]) \
                    and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(n)]


def near(v, cosine, r):
    other = r.standard_normal(len(v))
    other -= other @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


@pytest.mark.parametrize("block", [1024, 8])
def test_links_equal_brute_force(spark, clashing, monkeypatch, block):
    monkeypatch.setattr(capfilters, "BLOCK", block)
    r = np.random.default_rng(9)
    alone = [r.standard_normal(64) for _ in range(60)]
    chain = [r.standard_normal(64)]
    for _ in range(12):  # neighbours at the threshold, others not
        chain.append(near(chain[-1], 0.955, r))
    dense = [near(alone[0], c, r) for c in r.uniform(0.951, 0.9999, 80)]
    pairs = [near(v, 0.9502, r) for v in alone[1:31]] + [near(v, 0.9499, r) for v in alone[31:]]
    v = [x.tolist() for x in [*alone, *chain, *dense, *pairs]]
    v += [v[3]] * 9 + [[2.5 * x for x in v[4]]] + BAD + [[0.0] * 64, [1e-30] * 64, [3e30] * 64]
    v += [[1.0, 2.0], [1.0, 2.001], [2.0, -1.0], [1.0], [2.0], [-1.0]]
    links, component = plain_links(v)
    got = capfilters.groups(clashing(table(spark, v)))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert [(x.vec_id, x.n_links, x.component_id, x.kept) for x in
            got.orderBy("vec_id").collect()] == [
        (i, links[i], component[i], component[i] == i) for i in range(len(v))]


def test_recall_at_the_threshold():
    """Pairs right at the threshold share a filter, as among a hundred thousand classes."""
    r = np.random.default_rng(7)
    a = r.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.array([near(v, c, r) for v, c in zip(a, r.uniform(0.95, 0.955, len(a)))])
    f = capfilters.Filters(64, 100_000)
    hit = [len(np.intersect1d(x, y)) > 0 for x, y in zip(f.decode(a), f.decode(b))]
    assert np.mean(hit) >= 0.99
    held = [len(x) for x in f.decode(a)]
    assert min(held) >= capfilters.LEAST and np.mean(held) < 3 * capfilters.FILTERS


def test_decoded_filters_are_all_that_exceed():
    r = np.random.default_rng(11)
    f = capfilters.Filters(16, 500)
    x = r.standard_normal((20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ f.turn
    every = (turned[:, :8] @ f.code[0].T)[:, :, None] + (turned[:, 8:] @ f.code[1].T)[:, None, :]
    for found, sums in zip(f.decode(x), every.reshape(20, -1)):
        above = set(np.flatnonzero(sums >= f.alpha))
        if len(above) >= capfilters.LEAST:
            assert set(found) == above
        else:
            assert set(found) == set(np.argsort(-sums)[:min(capfilters.LEAST, f.size)])


def test_null_and_repeated_ids(spark):
    v = random_vectors(2, 64, 12)
    rows = capfilters.groups(table(spark, [v[0]] * 3 + [v[1]] * 2, [None, 4, 4, None, None])
                             ).collect()
    assert sorted((x.vec_id or -1, x.n_links, x.component_id or -1) for x in rows) == [
        (-1, 1, -1), (-1, 1, -1), (-1, 2, 4), (4, 2, 4), (4, 2, 4)]
