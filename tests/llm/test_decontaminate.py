import random
import re

import pytest

from tallyspark.llm import decontaminate


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def laid(doc, item):
    """Best (matched) over all diagonals, and best stretch of any, by brute force."""
    d, t = tokens(doc), tokens(item)
    best, stretch = 0, 0
    for start in range(-len(t) + 1, len(d)):
        same = [0 <= start + k < len(d) and d[start + k] == w for k, w in enumerate(t)]
        best = max(best, sum(same))
        now = 0
        for s in same:
            now = max(0, now + (1 if s else -2))
            stretch = max(stretch, now)
    return best, stretch


@pytest.fixture(scope="module")
def bench(spark, prose):
    items = [(i, prose(100 + i, n)) for i, n in enumerate((14, 25, 40, 59, 8, 5, 3))]
    items += [(50, items[1][1].upper()), (60, None), (None, ""), (61, prose(300, 60))]
    return spark.createDataFrame(items, "item_id long, text string")


def test_overlaps_equal_brute_force(docs, bench, prose):
    r = random.Random(4)
    items = [row for row in bench.collect() if row.text]
    texts = [None, "", prose(1, 300), prose(2, 6000)]
    for row in items:
        words = row.text.split()
        texts.append(prose(row.item_id, 30) + "\n" + row.text.upper() + ". " + prose(7, 20))
        texts.append(row.text)
        changed = [("zzz" if r.random() < 0.12 else w) + r.choice(["", "***", ","]) for w in words]
        texts.append(prose(9, 5) + " " + " ".join(changed))
        texts.append(" ".join(words[len(words) // 2:]) + " " + prose(3, 50))
    found = {(x.doc_id, x.item_id): x for x in
             decontaminate.overlaps(docs(texts), bench).collect()}
    want = set()
    for i, text in enumerate(texts):
        for row in items:
            if row.item_id == 50 or len(tokens(row.text)) < decontaminate.LEAST_TOKENS:
                continue
            best, stretch = laid(text, row.text)
            n = len(tokens(row.text))
            share = decontaminate.IDENTITY if n >= decontaminate.SPAN else 100
            if 100 * best >= share * n or stretch >= decontaminate.STRETCH:
                want.add((i, row.item_id))
                assert found[i, row.item_id].matched == best
    assert set(found) == want and len(want) > 20
    assert {x.n_items for x in found.values() if x.item_id == 1} == {2}


def test_large_seed_table_gives_the_same(docs, bench, prose, monkeypatch):
    texts = [prose(100, 14) + " " + prose(5, 10), prose(6, 60)]
    small = decontaminate.overlaps(docs(texts), bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert decontaminate.overlaps(docs(texts), bench).collect() == small and len(small) == 1


def test_removal_keeps_clean_rows_and_columns(docs, bench, clashing, prose):
    bad = "see " + prose(101, 25)
    table = clashing(docs([prose(1, 40), bad, bad, None, prose(2, 9), bad],
                          ids=[1, 1, 2, 3, None, None]))
    out = decontaminate.remove_overlapping(table, bench)
    assert out.columns == table.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == sorted(
        [(1, prose(1, 40)), (3, ""), (-1, prose(2, 9))])
    assert decontaminate.remove_overlapping(table.limit(0), bench).count() == 0
    assert decontaminate.remove_overlapping(table, bench.limit(0)).count() == 6


def highest(masks, wrong, n, anywhere):
    """Highest scores (word in place: +1, wrong one: ``wrong``) of texts of 1 to ``n`` words that
    no mask hits; of the whole text, or of a stretch of it ``anywhere``."""
    span = max(mask[-1] for mask in masks) + 1
    ends = [sum(1 << (mask[-1] - o) for o in mask) for mask in masks]
    scores, out = {0: 0}, []  # by the last words, one bit each
    for _ in range(n):
        after = {0: 0} if anywhere else {}
        for last, score in scores.items():
            for hit in (0, 1):
                seen = last << 1 | hit
                if not any(seen & end == end for end in ends):
                    key = seen & ((1 << span - 1) - 1)
                    after[key] = max(after.get(key, -10 ** 9), score + (1 if hit else wrong))
        scores = after
        out.append(max(scores.values()))
    return out


def test_no_accepted_text_is_missed_by_the_masks():
    share = decontaminate.IDENTITY / (100 - decontaminate.IDENTITY)
    whole = highest(decontaminate.MASKS, -share, 400, False)
    assert max(whole[4:]) < 0 and whole[-1] < whole[100]
    assert max(highest(decontaminate.MASKS, -2, 400, True)) < decontaminate.STRETCH


def test_a_quarter_replaced_is_found(spark, docs, prose):
    r = random.Random(8)
    items, texts = [], []
    for i in range(200):
        n = 11 + i % 10
        words = prose(1000 + i, n).split()
        items.append((i, " ".join(words)))
        for k in r.sample(range(n), n // 4):
            words[k] = "zzz"
        texts.append(f"{prose(2, 9)} {' '.join(words)} {prose(3, 9)}")
    items.append((200, "alba bruno carla dino elena fabio gino hilda ivo lara mino nora"))
    texts.append("zzz bruno carla dino zzz fabio gino zzz ivo lara mino nora")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id): x.matched for x in
             decontaminate.overlaps(docs(texts), bench).collect()}
    assert all(found.get((i, i)) == laid(texts[i], items[i][1])[0] for i in range(201))


def test_short_items_and_unspaced_scripts(spark, docs):
    items = ["who wrote the iliad", "name the longest river in africa", "capital of peru now ok",
             "法国的首都是哪座城市", "เมืองหลวงของไทย", "日本の首都", "osmosis"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["So, who wrote the Iliad?", "who wrote an iliad", "name the widest river in africa",
             "name the widest river in europe", "capital of chile now ok", "问：法国的首都是哪个城市？",
             "法国的人口是多少", "คำถาม เมืองหลวงของไทย", "これは日本の首都です", "by osmosis, then", "osmotic"]
    found = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs(texts), bench).collect()}
    assert found == {(0, 0), (2, 1), (4, 2), (5, 3), (7, 4), (8, 5), (9, 6)}
    kept = decontaminate.remove_overlapping(docs(texts), bench).collect()
    assert sorted(x.doc_id for x in kept) == [1, 3, 6, 9, 10]


def test_items_without_evidence_remove_whole_lines_only(spark, docs, prose):
    bench = spark.createDataFrame(
        [(0, "Yes"), (1, "New York"), (2, "a b c d"), (3, prose(11, 30)),
         (4, "it is so")],
        "item_id long, text string")
    texts = ["yes, we can", "Q: is it?\n YES! \nmore words here", "She left New York today",
             "answer:\r\nNew York.\r\n", "york new", None, "", "so a b c d it is so", "yes\u2028no",
             "see " + prose(11, 30), "yes " * 3000, "now it is so, they say"]
    found = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs(texts), bench).collect()}
    assert found == {(0, 0), (1, 0), (2, 1), (3, 1), (7, 2), (7, 4), (8, 0), (9, 3), (10, 0),
                     (11, 4)}
    kept = decontaminate.remove_overlapping(docs(texts), bench).collect()
    assert sorted(x.doc_id for x in kept) == [0, 2, 4, 5, 6, 8, 10, 11]


@pytest.mark.parametrize("limit", [0, 2_000_000])
def test_a_hot_short_item_leaves_the_stage_once_a_document(spark, docs, prose, limit, monkeypatch):
    """A word that a document holds 20,000 times is one hit of it before the exchange."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    bench = spark.createDataFrame([(0, "yes"), (1, prose(12, 20))], "item_id long, text string")
    texts = ["no " + "yes " * 20_000, prose(12, 20) + " yes", "yes\n" * 500, prose(5, 90)] * 2
    rows = decontaminate.overlaps(docs(texts), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.token_start, r.matched) for r in rows) == [
        (0, 0, 1, 1), (1, 0, 20, 1), (1, 1, 0, 20), (2, 0, 0, 1),
        (4, 0, 1, 1), (5, 0, 20, 1), (5, 1, 0, 20), (6, 0, 0, 1)]


def test_large_seed_tables_shuffle_no_words(docs, bench, prose, monkeypatch):
    """What is shuffled to its seed is a digest, a position and the seed."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    plan = decontaminate.overlaps(docs([prose(6, 60)]), bench)._jdf.queryExecution().optimizedPlan()
    sides, todo = [], [plan]
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        todo += children
        if node.nodeName() == "Join" and "(seed#" in node.simpleString(1000):
            sides.append(children[0].output().mkString(" "))
    assert len(sides) == 1 and "text_md5#" in sides[0]
    assert sorted(c.split("#")[0] for c in sides[0].split()) == ["at", "seed", "text_md5"]
