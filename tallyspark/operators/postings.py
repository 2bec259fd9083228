"""Postings of rare trigrams, made in Arrow batches without a shuffle.

The rarity of a trigram is the number of texts that hold one of its bucket, so a table of
``BUCKETS`` numbers, whatever the texts are, gives all tasks the same order of trigrams. Texts come
as words in lower case with one blank between them. The functions are sent to workers by value.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Bits of a text's sketch, in words of 64.
SKETCH_WORDS = 8
#: Bytes of text that a worker cuts into trigrams at once, a longer text alone.
SLICE_BYTES = 2 << 20


def _slices(batches):
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["words"]).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def _pieces(words):
    """Row and code of every three-letter piece of each word, padded as two blanks + word +
    blank; a code is three code points."""
    words = words.cast(pa.string())
    padded = pc.binary_join_element_wise("  ", pc.replace_substring(words, " ", "   "), " ", "")
    letters = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), np.uint32) \
        .astype(np.int64)
    rows = np.repeat(np.arange(len(words)), pc.utf8_length(padded).to_numpy())
    if len(letters) < 3:
        return rows[:0], letters[:0]
    # Where two blanks end a piece, it reaches over the end of a word.
    whole = (letters[1:-1] != 32) | (letters[2:] != 32)
    codes = (letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:]
    return rows[:-2][whole], codes[whole]


def _coded(codes):
    """The distinct codes, and the place of each code among them."""
    coded = pa.array(codes).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


def _mixed(codes):
    """64 bits for each code, every one of which depends on all three letters."""
    mixed = codes.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def _bucket(codes):
    return (_mixed(codes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_counts(batches):
    """(bucket, n): how often a text holds a trigram of a bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in _slices(batches):
        rows, codes = _pieces(batch["words"])
        found, of = _coded(codes)
        if len(found):
            once = np.unique(rows * len(found) + of) % len(found)
            np.add.at(total, _bucket(found), np.bincount(once, minlength=len(found)))
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])


def rare_postings(batches, counts, asked, threshold: float):
    """(gram, bucket, key, size, place, sketch_0 ...) from (key, words): the rarest trigrams of
    each text, as many as a similar text must hold one of, with their place by rarity and one bit
    for each trigram of the whole text; only of buckets that are ``asked``, if given."""
    names = ["gram", "bucket", "key", "size", "place",
             *[f"sketch_{w}" for w in range(SKETCH_WORDS)]]
    for batch in _slices(batches):
        rows, codes = _pieces(batch["words"])
        if not len(codes):
            continue
        found, of = _coded(codes)
        buckets = _bucket(found)
        order = np.lexsort((found, counts[buckets]))
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        keys = np.unique(rows * len(found) + rank[of])
        row, gram = keys // len(found), order[keys % len(found)]
        size = np.bincount(row, minlength=batch.num_rows)
        place = np.arange(len(row)) - (np.cumsum(size) - size)[row] + 1
        flags = np.zeros((batch.num_rows, 64 * SKETCH_WORDS), np.uint8)
        flags[row, (_mixed(found) & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64)[gram]] = 1
        sketch = np.packbits(flags, axis=1, bitorder="little").view(np.int64)
        # Fewer shared trigrams than the threshold asks for leave out no more than the rest.
        most = size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1
        kept = place <= most[row]
        if asked is not None:
            kept &= asked[buckets[gram]]
        row, gram, place = row[kept], gram[kept], place[kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[gram]), pa.array(buckets[gram]), batch["key"].take(pa.array(row)),
             pa.array(size[row]), pa.array(place)]
            + [pa.array(np.ascontiguousarray(sketch[:, w])[row]) for w in range(SKETCH_WORDS)],
            names)
