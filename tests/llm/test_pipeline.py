"""The registered queries and the pipeline on the smallest tables."""

import os
import re

import compare
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyspark.llm.pii import Permuter, replace
from tallyspark.llm.queries import ORACLES, PII_KEY, QUERIES

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables not present")


def test_each_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    verdict, _, rows = compare.compare(spark, compare.connection(TABLES), QUERIES[name],
                                       ORACLES[name], TABLES)
    assert verdict == "ok" and rows > 0


def test_stages(spark):
    """Each stage against its own input."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in docs.collect()} if "text" in docs.columns else {}
        docs = corpus_pipeline.written(stage(spark, docs, TABLES), "test")
        seen[name] = rows, docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        before, after = seen[name]
        assert after and [*after[0].asDict()] == columns
        assert {r.doc_id for r in after} <= set(before)
    before, after = seen["near duplicates"]

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    sets = {i: shingles(r.text) for i, r in before.items()}
    kept = sorted(r.doc_id for r in after)

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
    assert not any(alike(a, b) for a in kept for b in kept if a < b)
    for gone in set(before) - set(kept):
        assert any(alike(gone, other) for other in before if other < gone)
    before, after = seen["pii"]
    for r in after:
        assert r.text == replace(before[r.doc_id].text, Permuter(PII_KEY))[0]
    texts, pieces = seen["packing"]
    ids = {}
    for p in sorted(pieces, key=lambda p: p.start):
        ids.setdefault(p.doc_id, []).append(bytes(p.ids))
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(corpus_pipeline.vocabulary("word_bpe_49k.json"))
    assert set(ids) == set(texts)
    for i, r in texts.items():
        want = [*t.encode(r.text, add_special_tokens=False).ids, 1]
        assert b"".join(ids[i]) == np.array(want, "<u4").tobytes()
