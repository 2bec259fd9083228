import hashlib
import random

import pytest

from tallyspark.llm import warc
from tallyspark.llm.common import shared_folder

FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n"


@pytest.fixture(scope="module")
def pages():
    r = random.Random(5)
    rows = []
    for i in range(120):
        html = f"{i} " + "x" * r.randint(0, 150)
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            html += r.choice(["\r\n\r\nWARC/1.", "WARC/1.1\r\n", FAKE % r.randint(0, 300),
                              FAKE % 3 + "abc", "é\n", "\r\n\r\n"]) + "y" * r.randint(0, 99)
        rows.append((i, f"http://a/{i} \r\n\r\nWARC/1.1", html if i % 17 else None))
    same = "dup" * 50
    return rows + [(1000 + k, None, same) for k in range(5)] + [
        (900, "u", same), (1001, None, same), (2000, "", "short"), (2001, "", "short")]


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "").encode() == data)
        again = len(data) >= 100 and i != first
        out.append((i, "revisit" if again else "response", len(data),
                    hashlib.sha256(data).hexdigest(), first if again else -1,
                    b"" if again else data))
    return sorted(out)


@pytest.mark.parametrize("split", ["128m", "701"])
def test_round_trip(spark, pages, split):
    """Also with splits smaller than records, so that chains cross many of them."""
    path = shared_folder(spark, "warc")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string")
               .repartition(3), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                             "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = warc.pages_of(warc.read(spark, path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted((x.page_id, x.record_type, x.payload_bytes, x.payload_digest,
                  -1 if x.refers_to is None else x.refers_to, bytes(x.payload or b""))
                 for x in rows)
    assert got == expected(pages)


def test_nulls_and_nothing(spark):
    path = shared_folder(spark, "warc")
    rows = [(None, None, None), (None, "u", "z" * 200), (5, "u", "z" * 200), (5, "u", "z" * 200)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted(((x.page_id or 0), x.record_type, x.payload_bytes, x.refers_to or 0)
                 for x in warc.pages_of(warc.read(spark, path)).collect())
    assert got == [(0, "response", 0, 0), (0, "revisit", 200, 5), (5, "response", 200, 0),
                   (5, "response", 200, 0)]
    path = shared_folder(spark, "warc")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(empty, path)
    assert warc.read(spark, path).count() == 0


def test_other_writers_records(spark, tmp_path):
    """Binary blocks, fields in any case, a chain that ends at a broken record."""
    block = bytes(range(256)) + b"\r\n\r\nWARC/1.0\r\nContent-Length: 1\r\n\r\n" + b"\xff\xfe"
    record = b"WARC/1.0\r\ncontent-length: %d\r\nWARC-Type: resource\r\n\r\n%s\r\n\r\n"
    good = record % (len(block), block)
    path = tmp_path / "a.warc"
    path.write_bytes(good + record % (0, b"") + good + b"rubbish" + 50 * good)
    (tmp_path / "b.warc").write_bytes(b"rubbish\r\n\r\n" + good)
    rows = sorted(warc.read(spark, f"file://{tmp_path}").collect(), key=lambda x: x.offset)
    assert [(x.offset, bytes(x.block)) for x in rows] == [
        (0, block), (len(good), b""), (len(good) + len(record % (0, b"")), block)]
