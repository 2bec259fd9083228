import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; tables may have columns of these names too.
CLASHING = ("words h at seed class component bucket best_id best_times q_words q_text lines key0 "
            "unit part slot leftover kept _pii features label start").split()


def make_docs(spark, texts, langs=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, (langs[k] if langs else "en"), f"src{k % 3}", None if t is None else len(t))
            for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda texts, langs=None, ids=None: make_docs(spark, texts, langs, ids)


@pytest.fixture(scope="session")
def clashing():
    from pyspark.sql import functions as F

    def add(df):
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])
    return add


@pytest.fixture(scope="session")
def prose():
    """Sentences of invented words, the same for the same seed."""
    def make(seed, n):
        r = random.Random(seed)
        out = []
        for _ in range(n):
            out.append("".join(r.choice("bcdfglmnprst") + r.choice("aeiou")
                               for _ in range(r.randint(1, 4))))
        return " ".join(out)
    return make
