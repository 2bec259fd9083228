"""Multinomial logistic regression over stored blocks of term counts.

A pass over the blocks is one Spark job that sums loss and gradient of several models, so models
of different folds share what is read. Only coefficients, and their gradients, come to the
driver. The optimiser scales terms by the fourth root of their curvature. Spark's own scales them
by their deviation, which makes the penalty of rare terms thousands of times that of common
ones and takes many times the passes to the same optimum.

Functions that run in workers take and yield Arrow batches or numpy arrays, and are sent to the
workers by value.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that a worker splits into terms at once, a longer text alone.
SLICE_BYTES = 8 << 20
#: Bytes of gradients that the driver adds up without a stage of partial sums.
DIRECT_BYTES = 16 << 20
#: Steps that the optimiser's picture of the curvature rests on.
MEMORY = 30


@dataclass
class Model:
    """What a model is fitted on: its terms with their places in the blocks and their weights,
    its labels with the weight of a sample, and the part of the samples it does not see."""
    terms: list
    places: np.ndarray
    scale: np.ndarray
    labels: list
    weights: list
    unseen: int | None


# -- in workers ---------------------------------------------------------------------

def _slices(batches):
    """Batches cut so that their texts have at most SLICE_BYTES, but for single rows."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["_text"]).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def _split(texts):
    """Words of texts in order: row, code, and the word of each code."""
    lists = pc.split_pattern(texts, " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    rows, codes = pc.list_parent_indices(lists).to_numpy(), coded.indices.to_numpy()
    none = pc.index(coded.dictionary, "").as_py()
    held = codes != none
    return rows[held].astype(np.int64), codes[held].astype(np.int64), coded.dictionary


def _pairs(rows, codes, size: int):
    """Row and code of each pair of neighbouring words; the first word's code counts ``size``."""
    near = rows[1:] == rows[:-1]
    return rows[:-1][near], (codes[:-1] * size + codes[1:])[near]


def count_terms(batches, parts: int):
    """(term, uses_0, samples_0, ...): by part, how often a slice's samples use each term and
    how many hold it."""
    names = [f"{what}_{p}" for p in range(parts) for what in ("uses", "samples")]
    for batch in _slices(batches):
        part = batch["_part"].to_numpy().astype(np.int64)
        n = batch["n"].to_numpy().astype(np.float64)
        rows, codes, words = _split(batch["_text"])
        pair_rows, pairs = _pairs(rows, codes, len(words))
        found, pair_codes = np.unique(pairs, return_inverse=True)
        two = pc.binary_join_element_wise(words.take(pa.array(found // max(1, len(words)))),
                                          words.take(pa.array(found % max(1, len(words)))), " ")
        for at, of, terms in ((rows, codes, words), (pair_rows, pair_codes, two)):
            if not len(at):
                continue
            keys, uses = np.unique(at * len(terms) + of, return_counts=True)
            row, code = keys // len(terms), keys % len(terms)
            cells = code * parts + part[row]

            def summed(values):
                return np.bincount(cells, weights=values, minlength=len(terms) * parts) \
                    .astype(np.int64).reshape(-1, parts)
            u, s = summed(uses * n[row]), summed(n[row])
            kept = np.flatnonzero(s.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [terms.take(pa.array(kept)).cast(pa.string())]
                + [pa.array(x[kept, p]) for p in range(parts) for x in (u, s)],
                ["term", *names])


def _spread(batch, models, label_codes):
    """(weight, label) of a batch's rows for every model; rows a model does not see weigh 0."""
    n, part = batch["n"].to_numpy().astype(np.float64), batch["_part"].to_numpy()
    weight = np.zeros((len(models), len(n)))
    label = np.zeros((len(models), len(n)), np.int32)
    named = batch["label"].to_pylist()
    for m, ((_, _, _, weights, unseen), codes) in enumerate(zip(models, label_codes)):
        own = np.array([codes.get(name, -1) for name in named])
        seen = (own >= 0) & (True if unseen is None else part != unseen)
        label[m] = np.where(seen, own, 0)
        weight[m] = np.where(seen, n * np.array(weights)[label[m]], 0.0)
    return weight, label


def count_blocks(batches, terms: list, models: list):
    """One row for each slice: its rows' numbers of terms, the terms' places and counts, and for
    each model, given as a tuple, the rows' lengths, weights and labels."""
    label_codes = [{name: k for k, name in enumerate(labels)} for _, _, labels, _, _ in models]
    place = {t: k for k, t in enumerate(terms)}
    one = [t for t in terms if " " not in t]
    two = [t.split(" ") for t in terms if " " in t]
    one_places = np.array([place[t] for t in one], np.int64)
    two_places = np.array([place[" ".join(t)] for t in two], np.int64)
    for batch in _slices(batches):
        rows, codes, words = _split(batch["_text"])
        size = max(1, len(words))

        def codes_of(some):
            return pc.fill_null(pc.index_in(pa.array(some, words.type), words), -1) \
                .to_numpy(zero_copy_only=False).astype(np.int64)
        of_word = np.full(size, -1, np.int64)
        code = codes_of(one)
        of_word[code[code >= 0]] = one_places[code >= 0]
        first, second = codes_of([a for a, _ in two]), codes_of([b for _, b in two])
        known = (first >= 0) & (second >= 0)
        wanted = (first * size + second)[known]
        order = np.argsort(wanted)
        wanted, of_pair = wanted[order], two_places[known][order]
        pair_rows, pairs = _pairs(rows, codes, size)
        if len(wanted):
            at = np.minimum(np.searchsorted(wanted, pairs), len(wanted) - 1)
            met = wanted[at] == pairs
        else:
            at, met = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        places, held = of_word[codes], of_word[codes] >= 0
        keys, counts = np.unique(np.concatenate([
            rows[held] * len(terms) + places[held],
            pair_rows[met] * len(terms) + (of_pair[at[met]] if len(wanted) else at[met])]),
            return_counts=True)
        row, index = keys // max(1, len(terms)), keys % max(1, len(terms))
        length = np.zeros((len(models), batch.num_rows))
        for m, (own_places, own_scale, *_) in enumerate(models):
            scale = np.zeros(len(terms))
            scale[own_places] = own_scale
            squares = np.bincount(row, weights=(counts * scale[index]) ** 2,
                                  minlength=batch.num_rows)
            length[m] = np.divide(1.0, np.sqrt(squares), out=np.zeros(len(squares)),
                                  where=squares > 0)
        weight, label = _spread(batch, models, label_codes)
        sizes = np.bincount(row, minlength=batch.num_rows).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a.tobytes()], pa.binary()) for a in (
                sizes, index.astype(np.int32), counts.astype(np.int32), length, weight, label)],
            BLOCK)


BLOCK = ["sizes", "places", "counts", "length", "weight", "label"]


def _gradients(blocks, trials: dict, terms: int):
    """{model: loss, gradient by place, gradient of intercepts}, summed over blocks."""
    total = {m: [0.0, np.zeros((len(b) - 1, terms)), np.zeros(len(b))]
             for m, (_, b) in trials.items()}
    for block in blocks:
        sizes = np.frombuffer(block[0], np.int32)
        index = np.frombuffer(block[1], np.int32).astype(np.intp)
        counts = np.frombuffer(block[2], np.int32).astype(np.float64)
        length, weight = (np.frombuffer(x, np.float64).reshape(-1, len(sizes))
                          for x in block[3:5])
        label = np.frombuffer(block[5], np.int32).reshape(-1, len(sizes))
        every = np.arange(len(sizes))
        row = np.repeat(every, sizes)
        for m, (w, b) in trials.items():
            margins = np.empty((len(b), len(sizes)))
            # Coefficients add up to zero over the labels, so the last follow from the others.
            for k in range(len(b) - 1):
                margins[k] = np.bincount(row, weights=counts * w[k][index],
                                         minlength=len(sizes)) * length[m] + b[k]
            margins[-1] = -margins[:-1].sum(axis=0)
            top = margins.max(axis=0)
            shares = np.exp(margins - top)
            sums = shares.sum(axis=0)
            loss = weight[m] * (np.log(sums) + top - margins[label[m], every])
            rest = shares / sums * weight[m]
            rest[label[m], every] -= weight[m]
            total[m][0] += loss.sum()
            for k in range(len(b) - 1):
                total[m][1][k] += np.bincount(
                    index, weights=counts * (rest[k] * length[m])[row], minlength=terms)
            total[m][2] += rest.sum(axis=1)
    return total


def _sizes(blocks, models: int, terms: int):
    """(weight, weighted squares of the values by place) of every model, summed over blocks; the
    squares don't have the terms' own weights yet."""
    weights, squares = np.zeros(models), np.zeros((models, terms))
    for block in blocks:
        sizes = np.frombuffer(block[0], np.int32)
        index, counts = np.frombuffer(block[1], np.int32), np.frombuffer(block[2], np.int32)
        length, weight = (np.frombuffer(x, np.float64).reshape(-1, len(sizes))
                          for x in block[3:5])
        row = np.repeat(np.arange(len(sizes)), sizes)
        weights += weight.sum(axis=1)
        for m in range(models):
            squares[m] += np.bincount(
                index, weights=counts.astype(np.float64) ** 2 * (length[m] ** 2 * weight[m])[row],
                minlength=terms)
    return weights, squares


def _added(a: dict, b: dict) -> dict:
    return {m: [x + y for x, y in zip(a[m], b[m])] for m in a}


# -- on the driver ------------------------------------------------------------------

def stored_blocks(texts: DataFrame, terms: list, models: list) -> RDD:
    """Blocks of (label, _text, n, _part) rows for the models, kept by the executors."""
    shared = texts.sparkSession.sparkContext.broadcast((terms, [
        (m.places, m.scale, m.labels, m.weights, m.unseen) for m in models]))
    blocks = texts.select("label", "_text", "n", "_part").mapInArrow(
        lambda batches: count_blocks(batches, *shared.value),
        ", ".join(f"{name} binary" for name in BLOCK))
    return blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _summed(blocks: RDD, trials: dict, terms: int) -> dict:
    """Loss and gradient of every trial over all blocks."""
    shared = blocks.context.broadcast(trials)
    size = 8 * terms * sum(len(b) - 1 for _, b in trials.values()) * blocks.getNumPartitions()
    try:
        return blocks.mapPartitions(
            lambda some: [_gradients(some, shared.value, terms)]).treeReduce(
                _added, depth=1 if size <= DIRECT_BYTES else 2)
    finally:
        shared.destroy()


def minimum(start: np.ndarray, done, most: int):
    """The minimum of a smooth convex function by L-BFGS, as a generator: it yields points and
    is sent value and gradient there, and returns the last point. ``done`` tells from value
    and gradient whether to stop; there are at most ``most`` steps."""
    x, steps = start, []
    f, g = yield x
    for _ in range(most):
        if done(f, g):
            break
        d, shares = -g, []
        for s, y in reversed(steps):
            shares.append((s @ d) / (y @ s))
            d = d - shares[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), share in zip(steps, reversed(shares)):
            d = d + s * (share - (y @ d) / (y @ s))
        slope, low, high = g @ d, 0.0, None
        length = 1.0 if steps else 1.0 / max(np.linalg.norm(g), 1e-300)
        for _ in range(50):  # halve or double until the step is neither too long nor too short
            f2, g2 = yield x + length * d
            if f2 > f + 1e-4 * length * slope:
                high = length
            elif g2 @ d < 0.9 * slope:
                low = length
            else:
                break
            length = 2 * length if high is None else (low + high) / 2
        s, y = length * d, g2 - g
        if f2 >= f or s @ y <= 0:
            break  # as near as numbers of this precision come
        steps = [*steps[1 - MEMORY:], (s, y)]
        x, f, g = x + s, f2, g2
    return x


def fit_all(blocks: RDD, terms: int, models: list, samples: list, tolerance: float,
            most: int) -> list:
    """(coefficients by label and term, intercepts) of every model.

    The loss is the weighted mean over samples plus half the squared coefficients by the number
    of ``samples``. A model is done when its loss is within ``tolerance`` of the
    least one, in proportion: a function that curves at least by c is at most the gradient's
    square by 2 c above its minimum. All models go on side by side, a pass for each step.
    """
    many = len(models)
    totals, squares = blocks.mapPartitions(lambda some: [_sizes(some, many, terms)]).treeReduce(
        lambda a, b: (a[0] + b[0], a[1] + b[1]))
    roots = []
    for m, model in enumerate(models):
        k = max(2, len(model.labels))
        curve = squares[m][model.places] * model.scale ** 2 / totals[m] * (k - 1) / k ** 2
        roots.append(np.tile(np.append(curve + 1 / samples[m], 1.0) ** -0.25, len(model.labels)))
    result = [(np.zeros((len(m.labels), len(m.terms))), np.full(len(m.labels), np.inf))
              for m in models]

    def parts(m: int, x: np.ndarray):
        k = len(models[m].labels)
        both = (x * roots[m]).reshape(k, -1)
        both = both - both.mean(axis=0)
        return both[:, :-1], both[:, -1]

    def search(m: int):
        def done(f, g):
            g = g / roots[m]
            return g @ g * samples[m] <= 2 * tolerance * f

        return minimum(np.zeros(len(roots[m])), done, most)

    # A model of one label needs no search: that label is certain.
    searches = {m: search(m) for m, model in enumerate(models) if len(model.labels) > 1}
    points = {m: next(s) for m, s in searches.items()}
    while points:
        trials = {}
        for m, x in points.items():
            w, b = parts(m, x)
            whole = np.zeros((len(b) - 1, terms))
            whole[:, models[m].places] = w[:-1] * models[m].scale
            trials[m] = (whole, b)
        for m, (loss, by_place, by_label) in _summed(blocks, trials, terms).items():
            w, b = parts(m, points[m])
            data = by_place[:, models[m].places] * models[m].scale
            data = np.concatenate([data, -data.sum(axis=0, keepdims=True)]) / totals[m]
            value = loss / totals[m] + (w * w).sum() / (2 * samples[m])
            slope = np.concatenate([data + w / samples[m], by_label[:, None] / totals[m]], axis=1)
            try:
                points[m] = searches[m].send((value, slope.ravel() * roots[m]))
            except StopIteration as end:
                del points[m]
                result[m] = parts(m, end.value)
    return result
