import random

import numpy as np
import pytest

from tallyspark.llm import neardup
from tallyspark.llm.components import components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """doc_id, set size, component by comparing all pairs; ids are distinct and not null."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows)))


@pytest.fixture(scope="module")
def rows(prose):
    r = random.Random(8)
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three four", "É a b c", "é a b c"]
    for g in range(14):
        words = prose(g, r.choice((9, 40, 120, 400))).split()
        for _ in range(r.randint(1, 9)):
            copy = [("new" if r.random() < 0.012 else w) for w in words]
            texts.append(r.choice([" ", "\n"]).join(copy))
        words = [("x" if r.random() < 0.04 else w) for w in words]
        texts += [" ".join(words), " ".join(words).title(), " ".join(words)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("small", [32, 2])
def test_groups_equal_brute_force(docs, rows, monkeypatch, small):
    """Once with small buckets joined, once with all of them in blocks of a few members."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    found = neardup.groups(docs([t for _, t in rows], ids=[i for i, _ in rows]), size=4)
    got = found.collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows, 4, 80)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_a_chain_hangs_together(docs, prose):
    """Each text is similar to the next; the ends are not similar."""
    words = prose(3, 100).split()
    texts = [" ".join(["q%d" % j for j in range(6 * i)] + words[6 * i:]) for i in range(6)]
    found = neardup.groups(docs(texts), size=1).collect()
    want = brute(list(enumerate(texts)), 1, 80)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found) == want
    assert {c for _, _, c in want} == {0}


def test_deduplicate_keeps_one_row_and_all_columns(docs, clashing, prose):
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    table = clashing(docs([a, a, a + " end", b, b, b, None, "", c, c + " x"],
                          ids=[3, 3, 2, None, None, 9, 4, 4, None, None]))
    out = neardup.deduplicate(table)
    assert out.columns == table.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    kept_c = [x for x in got if x[2].startswith(c)]
    assert len(kept_c) == 1 and kept_c[0][0]
    got.remove(kept_c[0])
    assert got == [(False, 2, a + " end"), (False, 4, ""), (False, 4, ""), (False, 9, b)]
    assert neardup.deduplicate(table.limit(0)).count() == 0


def test_repeated_rows_leave_one(docs, prose):
    assert neardup.deduplicate(docs([prose(1, 30)] * 4, ids=[7] * 4)).count() == 1


def test_sketches_estimate_high_similarities():
    signer, random_ = neardup.Signer(), np.random.default_rng(1)
    for share in (0.8, 0.9, 0.97):
        for _ in range(40):
            pool = random_.integers(0, 2**63, 2000, "u8")
            n = 1000
            same = round(2 * n * share / (1 + share))
            a, b = np.unique(pool[:n]), np.unique(pool[n - same:2 * n - same])
            ones = int(np.bitwise_count(signer.sign(a)[1].view("u8")
                                        ^ signer.sign(b)[1].view("u8")).sum())
            assert ones <= neardup.most_ones(80)
    far = [random_.integers(0, 2**63, 1000, "u8") for _ in range(2)]
    assert int(np.bitwise_count(signer.sign(far[0])[1].view("u8")
                                ^ signer.sign(far[1])[1].view("u8")).sum()) > neardup.most_ones(80)


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [
        (r.randint(200, 300), r.randint(200, 300)) for _ in range(60)]
    links = [(a, b) for a, b in links if a != b]
    found = {x.node: x.component for x in
             components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for link in links for x in link}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == parent
