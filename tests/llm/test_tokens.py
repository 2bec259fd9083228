import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tallyspark.llm import packing, tokenfile
from tallyspark.llm.common import shared_folder
from tallyspark.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library_ids(name, text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize("name", FILES)
def test_chunks_give_the_library_ids(name, special_as_text, prose):
    from tokenizers import Tokenizer
    r = random.Random(3)
    odd = ["", " ", "<|endoftext|>", "hello <|endoftext|> world <|startoftext|>", "\n\n a  b \t c\x1cd !\x1c! \xa0x　y  ", "a\x85b  c", "İİ İx, Σς ΑΣ ǰ ŉ ẞ",
           "café ́x <|endoftext|>b don't 'll\n's", "１２ ½ 中文 😀​ ‍x",
           "w" * 300 + " x", prose(1, 500), prose(2, 30).upper() + "!!! " + prose(3, 9) + "\n"]
    marks = " \n\t\x1c\xa0ab'sé1.,!<|>́İß\0-_"
    odd += ["".join(r.choice(marks) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    encoder = Encoder(public_tokenizers.path(name), special_as_text)
    assert encoder.split is not None
    got = encoder.encode([None, *odd])
    assert got[0] == b""
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = special_as_text
    for text, ids in zip(odd, got[1:]):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)


def test_cache_may_overflow(monkeypatch, prose):
    import tallyspark.llm.tokens as tokens
    path = public_tokenizers.path(FILES[0])
    texts = [prose(k, 200) for k in range(6)]
    want = Encoder(path).encode(texts)
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 150)
    small = Encoder(path)
    assert [small.encode([t])[0] for t in texts] == want


TEXTS = 40


@pytest.fixture(scope="module")
def table(docs, clashing, prose):
    r = random.Random(1)
    texts = [None, ""] + [prose(k, r.choice((1, 30, 300, 3000))) for k in range(TEXTS)]
    return clashing(docs(texts + texts[-3:], ids=[*range(TEXTS + 2), 7, 7, None]))


def pieces_are_whole(rows, texts, size):
    seq, docs = defaultdict(list), defaultdict(list)
    for x in rows:
        seq[x.sequence_id].append(x)
        docs[x.doc_id, x.doc_tokens].append(x)
    for pieces in seq.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at and x.length > 0 and len(x.ids) == 4 * x.length
            at += x.length
        assert at <= size
    return seq, docs


def test_packing_loses_nothing_and_pads_little(table):
    path = public_tokenizers.path(FILES[1])
    rows = packing.pack(table.where("doc_id <> 7").repartition(5), path, size=256,
                        windows=4).collect()
    seq, docs = pieces_are_whole(rows, table, 256)
    for t in table.where("doc_id <> 7").collect():
        want = np.array([*library_ids(FILES[1], t.text), 1], "<u4").tobytes()
        pieces = sorted(docs[t.doc_id, len(want) // 4], key=lambda x: x.start)
        assert b"".join(x.ids for x in pieces) == want
        assert [x.start for x in pieces] == [
            sum(y.length for y in pieces[:k]) for k in range(len(pieces))]
    used = sum(x.length for x in rows)
    assert sum(256 - sum(x.length for x in s) > packing.SLACK for s in seq.values()) <= 1
    assert len(seq) <= used / (256 - packing.SLACK) + 1


def test_leftovers_merge_over_rounds(table, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 2)
    rows = packing.pack(table.repartition(9), public_tokenizers.path(FILES[1])).collect()
    seq, docs = pieces_are_whole(rows, table, 2048)
    tokens = sum(len(library_ids(FILES[1], t.text)) + 1 for t in table.collect())
    assert sum(x.length for x in rows) == tokens
    assert sum(2048 - sum(x.length for x in s) > packing.SLACK for s in seq.values()) <= 1


def test_packing_of_nothing(table):
    assert packing.pack(table.limit(0), public_tokenizers.path(FILES[1])).count() == 0


def test_levels_give_random_access():
    r = np.random.default_rng(5)
    for ids in (np.zeros(1), r.integers(0, 256, 1000), r.integers(0, 60000, 5000),
                r.integers(0, 2**32, 3000), 2 ** r.integers(0, 32, 2100)):
        ids = ids.astype("<u4")
        data = tokenfile.encode_file(3, 9, [5, None], [1, len(ids) - 1], ids)
        file = tokenfile.TokenFile(data + tokenfile.ENDMARK.encode())
        assert (file.ids() == ids).all() and len(file) == len(ids)
        for i in {0, len(ids) - 1, *r.integers(0, len(ids), 300).tolist()}:
            assert file[i] == ids[i]
        assert file.docs == [5, None] and file.before == 9 and file.partition == 3


def test_token_files_round_trip(spark, table):
    path = shared_folder(spark, "test")
    tokenfile.write(table, path, public_tokenizers.path(FILES[0]), file_ids=3000)
    assert spark.read.format("binaryFile").load(path).count() > 3
    rows = sorted(tokenfile.read(spark, path).collect(), key=lambda x: x.start)
    digests = {x.start: x for x in tokenfile.read_digests(spark, path).collect()}
    want = sorted((t.doc_id is not None, t.doc_id or 0, np.array(
        [*library_ids(FILES[0], t.text), 0], "<u4").tobytes()) for t in table.collect())
    got = [(x.doc_id is not None, x.doc_id or 0, bytes(x.ids)) for x in rows]
    assert [x[:2] for x in got] == [x[:2] for x in want] and sorted(got) == want
    at = 0
    for x in rows:
        assert x.start == at and x.n_tokens == len(x.ids) // 4
        assert digests[at].ids_crc32 == zlib.crc32(x.ids)
        at += x.n_tokens


def test_token_files_of_nothing(spark, table):
    path = shared_folder(spark, "test")
    tokenfile.write(table.limit(0), path, public_tokenizers.path(FILES[0]))
    assert tokenfile.read(spark, path).count() == 0
