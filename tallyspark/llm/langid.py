"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A three-letter gram is the product of its
letters' vectors, the first rotated twice and the second once, so order counts. A text's vector
is the sum of its grams' vectors; a language's prototype is the sum over its training texts.
A text gets the language whose prototype has the highest cosine with it.

Training is one pass: each task adds grams up for each language and turns the counts into
vectors at its end, so what is shuffled is one vector for each task and language; prototypes
(languages times ``DIMENSIONS`` numbers) come to the driver. There is no sample: all labelled
texts train. Letter vectors follow from the letter's code point, so workers agree on them.

Letters are what Unicode calls alphabetic, in lower case; other runs count as one space. The
score is the cosine, not below 0, and 0 for ``und``.

Defined cases: null texts and texts without a letter, or a table without training rows: ``und``;
rows with a null language do not train; ties go to the language first in order; repeated rows
count each time; other columns aren't read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import ship

DIMENSIONS = 1024
SEED = 11
CACHED_GRAMS = 60_000
#: Grams of a task's training counts are turned into vectors when there are so many.
MOST_COUNTS = 200_000
LETTER_BITS = 21

_state: dict = {}


def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if "letters" not in _state:
        _state["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool,
                                        0x110000)
    return _state["letters"]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct three-letter grams of a text as 63-bit codes, with their counts."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_letters()[points], points, 32).astype("i8")
    if (points == 32).all():
        return None
    points = np.concatenate([[32], points, [32]])
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    codes = (points[:-2] << 2 * LETTER_BITS) | (points[1:-1] << LETTER_BITS) | points[2:]
    return np.unique(codes, return_counts=True)


class Space:
    """Letter and gram vectors. Gram vectors are kept in one array of bounded size."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letters: dict = {}
        self.row: dict = {}
        self.vectors = np.empty((CACHED_GRAMS, dimensions), "i1")

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            bits = np.random.default_rng([SEED, point]).integers(0, 2, self.dimensions, "i1")
            self.letters[point] = bits * np.int8(2) - np.int8(1)
        return self.letters[point]

    def gram(self, code: int) -> np.ndarray:
        mask = (1 << LETTER_BITS) - 1
        return (np.roll(self.letter(code >> 2 * LETTER_BITS), 2)
                * np.roll(self.letter(code >> LETTER_BITS & mask), 1) * self.letter(code & mask))

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the grams' vectors, each as often as it is counted."""
        total = np.zeros(self.dimensions, "f8")
        for at in range(0, len(codes), 4096):
            part = codes[at:at + 4096].tolist()
            missing = [c for c in part if c not in self.row]
            if len(self.row) + len(missing) > CACHED_GRAMS:
                self.row.clear()
                missing = part
            for c in missing:
                self.row[c] = len(self.row)
                self.vectors[self.row[c]] = self.gram(c)
            rows = np.fromiter(map(self.row.__getitem__, part), "i8", len(part))
            total += counts[at:at + 4096].astype("f4") @ self.vectors[rows].astype("f4")
        return total


def _space(dimensions: int) -> Space:
    if _state.get("dimensions") != dimensions:
        _state["dimensions"], _state["space"] = dimensions, Space(dimensions)
    return _state["space"]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages of all rows with a language."""
    ship(labelled.sparkSession)

    def sums(batches):
        space, counts, vectors = _space(dimensions), {}, {}

        def fold():
            for lang, found in counts.items():
                codes = np.fromiter(found, "i8", len(found))
                vectors[lang] = vectors.get(lang, 0) + space.bundle(
                    codes, np.fromiter(found.values(), "i8", len(found)))
            counts.clear()

        for batch in batches:
            texts, langs = (batch.column(k).to_pylist() for k in (0, 1))
            pending: dict = {}
            for text, lang in zip(texts, langs):
                if found := grams(text):
                    pending.setdefault(lang, []).append(found)
            for lang, found in pending.items():
                codes, where = np.unique(np.concatenate([f[0] for f in found]),
                                         return_inverse=True)
                total = np.bincount(where, np.concatenate([f[1] for f in found]))
                own = counts.setdefault(lang, {})
                for c, n in zip(codes.tolist(), total.tolist()):
                    own[c] = own.get(c, 0) + n
            if sum(map(len, counts.values())) > MOST_COUNTS:
                fold()
        fold()
        for lang, vector in vectors.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()),
                 pa.array(vector, pa.float64())], ["lang", "at", "value"])

    rows = (labelled.where(F.col(lang_col).isNotNull())
            .select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
            .mapInArrow(sums, "lang string, at int, value double")
            .groupBy("lang", "at").agg(F.sum("value").alias("value"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value")))["value"])
            .orderBy("lang").collect())
    found = {lang: np.array(vector) for lang, vector in rows}
    return {lang: v / np.linalg.norm(v) for lang, v in found.items() if v.any()}


def predict(documents: DataFrame, prototypes: dict[str, np.ndarray], keep=("doc_id",),
            text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row with ``lang_pred`` and ``score``."""
    ship(documents.sparkSession)
    names = sorted(prototypes)
    dimensions = len(next(iter(prototypes.values()))) if prototypes else DIMENSIONS
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), dimensions)
    fields = [f"keep{k}" for k in range(len(keep))]
    rows = documents.select(*[F.col(c).alias(f) for c, f in zip(keep, fields)],
                            F.col(text_col).cast("string").alias("text"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{f} {kinds[f]}" for f in fields] + ["lang_pred string, score double"])

    def label(batches):
        space = _space(dimensions)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(len(fields)).to_pylist():
                found = grams(text) if names else None
                if found is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                vector = space.bundle(*found)
                cosines = matrix @ vector / max(np.linalg.norm(vector), 1e-12)
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(min(max(float(cosines[best]), 0.0), 1.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(fields)], pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64())], [*fields, "lang_pred", "score"])

    return rows.mapInArrow(label, schema).toDF(*keep, "lang_pred", "score")
