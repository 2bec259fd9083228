import random

import numpy as np
import pytest

from tallyspark.llm import langid, secretscan

SYLLABLES = {"aa": "ba da ga la ma na".split(), "bb": "zel kri ost ump ith".split(),
             "cc": "éa où çi ño üt".split()}


def text_of(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def table(docs, clashing):
    r = random.Random(4)
    texts, langs = [], []
    for k in range(150):
        lang = r.choice(list(SYLLABLES))
        texts.append(text_of(r, lang, r.choice((2, 20, 2000 if k < 3 else 50))))
        langs.append(lang)
    texts += [None, "", "12 34 !?", texts[0], texts[0]]
    langs += ["aa", "bb", "cc", None, langs[0]]
    return clashing(docs(texts, langs))


def test_held_out_accuracy(table):
    prototypes = langid.train(table.where("doc_id % 3 <> 1"))
    assert sorted(prototypes) == ["aa", "bb", "cc"]
    out = langid.predict(table, prototypes).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in table.collect()}
    assert len(out) == len(truth)
    held = [x for x in out if x.doc_id % 3 == 1 and x.doc_id < 150]
    assert sum(x.lang_pred == truth[x.doc_id][0] for x in held) >= 0.97 * len(held)
    for x in out:
        letters = any(c.isalpha() for c in truth[x.doc_id][1] or "")
        assert (x.lang_pred == "und") != letters and 0 <= x.score <= 1


def test_a_bundle_is_the_sum_of_its_grams(table):
    space = langid.Space(256)
    codes, counts = langid.grams("Abc ab, abc")
    want = np.zeros(256)
    padded = " abc ab abc "
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        want += (np.roll(space.letter(ord(a)), 2) * np.roll(space.letter(ord(b)), 1)
                 * space.letter(ord(c)))
    assert (space.bundle(codes, counts) == want).all()


def test_no_training_rows(table):
    assert langid.train(table.limit(0)) == {}
    out = langid.predict(table, {}, ("doc_id", "lang"))
    assert out.columns == ["doc_id", "lang", "lang_pred", "score"]
    assert {x.lang_pred for x in out.collect()} == {"und"}


def test_forest_removes_false_findings(docs, clashing, prose):
    texts = [prose(k, 80) for k in range(500)]
    labelled = secretscan.labelled_findings(docs(texts))
    rows = labelled.collect()
    assert len(rows) > 450 and 0.35 < np.mean([x.label for x in rows]) < 0.65
    learn, held = labelled.randomSplit([0.7, 0.3], seed=1)
    forest = secretscan.train(learn)
    from pyspark.ml.functions import array_to_vector
    held = forest.transform(held.withColumn("features", array_to_vector("features")))
    right = held.where("prediction = label").count() / held.count()
    assert right >= 0.95

    key = "8b1f0c9a7d3e4f5061728394a5b6c7d8e9f00112"
    cases = [f'set token = "{key}" now', f"as of commit {key} it works",
             'password = "changeme-password-1"', None, "", prose(1, 30),
             prose(2, 3000) + f' api_key: "{key}"', f'set token = "{key}" now']
    table = clashing(docs(cases, ids=[0, 1, 2, 3, 4, 5, None, 0]))
    found = secretscan.judge(secretscan.found(table), forest).collect()
    secrets = sorted((-1 if x.doc_id is None else x.doc_id) for x in found if x.is_secret)
    assert secrets == [-1, 0, 0]
    assert {x.doc_id for x in found if not x.is_secret} >= {1}
    place = next(x for x in found if x.doc_id == 0)
    assert cases[0][place.start:place.start + place.length] == key


def test_bounds_and_empty_tables(docs, prose):
    texts = docs([prose(k, 30) for k in range(60)] + ["same"] * 40)
    assert secretscan.labelled_findings(texts, most=10).count() <= 10
    assert secretscan.scan(texts.limit(0)).count() == 0
    assert secretscan.scan(docs([None, ""])).count() == 0


SECRETS = ['password = "Tr0ub4dor3x9"', "url postgres://app:s3cr3tPa55@db",
           'password: "c0rrect!Horse#Battery9$staple"', "app password: abcdqrstefghwxyz",
           "secret=83920175"]
VALUES = ["Tr0ub4dor3x9", "s3cr3tPa55", "c0rrect!Horse#Battery9$staple", "abcdqrstefghwxyz",
          "83920175"]


def test_short_secrets_and_symbols_are_candidates():
    for text, value in zip(SECRETS, VALUES):
        whole = f"see {text} there"
        assert value in [whole[a:b] for a, b in secretscan.candidates(whole)], text
    assert secretscan.candidates("the monkeys tokenise keyboards") == []
    assert secretscan.candidates('key = "' + "7" * 40 + '"') == [(7, 47)]


def test_short_secrets_are_found(docs, prose):
    texts = [f"{prose(k, 20)} {text} {prose(k + 9, 20)}" for k, text in enumerate(SECRETS)]
    clean = ["set the password to the new one and keep it", 'password = "${DB_PASSWORD}"',
             "http://user:password@host/ is the form", 'password = "changeme"']
    plain = [prose(k, 60) for k in range(100, 1100)]
    rows = secretscan.scan(docs(texts + clean + plain)).where("is_secret").collect()
    got = {(x.doc_id, (texts + clean + plain)[x.doc_id][x.start:x.start + x.length]) for x in rows}
    assert got >= set(enumerate(VALUES))
    assert not any(len(texts) <= k for k, _ in got)


def test_copies_do_not_empty_the_training(docs, prose):
    key = 'set token = "8b1f0c9a7d3e4f5061728394a5b6c7d8e9f00112" now ' + prose(1, 30)
    found = secretscan.scan(docs([key] * 40)).collect()
    assert len([x for x in found if x.is_secret]) == 40
    few = docs([prose(1, 30)] * 300 + [prose(2, 30)], ids=range(301))
    rows = secretscan.labelled_findings(few, most=10).collect()
    assert {x.label for x in rows} == {0.0, 1.0} and len(rows) == 10
