"""Near-duplicate vectors by spherical-cap filters.

1. Equal vectors form one class; only classes go on, with their numbers of rows.
2. A filter is a direction, and a vector exceeds it if their cosine is at least ``alpha``. The
   directions are a random product code: after a random rotation the components are cut into
   two blocks, each with ``size`` random unit vectors, and every pair of them is a direction. So
   ``size`` squared filters need twice ``size`` stored vectors, and a vector's list is decoded
   without trying them all: only products that the best opposite one lifts over the limit meet.
   A vector that exceeds fewer than ``LEAST`` filters takes its best ``LEAST`` ones.
3. Classes that share a filter meet in its bucket. Each bucket compares its members with one
   hub, its least class: sign sketches of 128 bits drop pairs far apart (cosine 0.95 differs in
   13 bits; ``MOST_BITS`` is eight standard deviations above), the others are verified on whole
   vectors, first one hub for each class and then only pairs that no link joins yet. Links make
   components.
4. Buckets whose members other than the hub still lie in several components are compared in
   blocks of ``BLOCK`` a side; of a dense bucket only links that join components leave a task.
5. Links are counted inside components. Vectors within half the angle of a component's centre
   are linked with each other by the triangle inequality and need no comparison; the others
   are compared with all of the component in blocks. So a group of close copies, however
   large, costs one comparison a vector, no pair leaves a task, and every pair of a component
   counts, whether it shares a filter or not.

``alpha`` and the number of filters follow from the number of classes: a filter holds
``OCCUPANCY`` unrelated vectors on average, and a vector exceeds some ``FILTERS`` filters. Where
few dimensions make caps small, ``alpha`` is held down. Recall is measured in the tests and the
README, on the given vectors and on pairs made to lie at the threshold.

Cosines are of doubles. Defined cases: null or empty vectors, zero vectors and those with null
or non-finite components have no links and are their own components; vectors of different
lengths aren't linked; repeated rows are linked with each other; equal ids are rows of their
own, and a null id is a component's id only if all its ids are null. Other columns aren't read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import ship, written
from tallyspark.llm.components import components
from tallyspark.llm.vectors import finite, lists

COSINE = 0.95
FILTERS = 24
LEAST = 20
OCCUPANCY = 0.1
SKETCH = 128
MOST_BITS = 40
BLOCK = 1024
SEED = 13


def cap_share(alpha: float, dimensions: int) -> float:
    """Share of the unit sphere with a cosine of at least ``alpha`` to a direction."""
    if dimensions < 2:
        return 0.5
    angle = np.linspace(0.0, math.pi, 20_001)
    density = np.sin(angle) ** (dimensions - 2)
    return float(density[angle <= math.acos(alpha)].sum() / density.sum())


def limits(classes: int, dimensions: int) -> tuple[float, int]:
    """(alpha, code vectors a block) for a number of classes."""
    low, high = 0.0, min(0.85, 7.5 / math.sqrt(dimensions + 54))
    wanted = OCCUPANCY / max(classes, 1)
    if cap_share(high, dimensions) < wanted:
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if cap_share(middle, dimensions) > wanted else (low, middle)
    filters = FILTERS / cap_share(high, dimensions)
    return high, max(2, math.ceil(math.sqrt(filters)))


class Filters:
    """The product code for vectors of one length."""

    def __init__(self, dimensions: int, classes: int):
        random = np.random.default_rng([SEED, dimensions])
        self.alpha, self.size = limits(classes, dimensions)
        self.turn = np.linalg.qr(random.standard_normal((dimensions, dimensions)))[0]
        self.cut = dimensions // 2
        self.code = []
        for width in (self.cut, dimensions - self.cut):
            v = random.standard_normal((self.size, width))
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            # A block's share of the direction goes with its length.
            self.code.append(v / np.maximum(norm, 1e-300) * math.sqrt(width / dimensions))
        self.planes = random.standard_normal((dimensions, SKETCH))

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Numbers of the filters that each unit vector exceeds."""
        out = []
        least, step = min(LEAST, self.size), max(1, 4_000_000 // self.size)
        for at in range(0, len(unit), step):
            x = unit[at:at + step] @ self.turn
            left, right = x[:, :self.cut] @ self.code[0].T, x[:, self.cut:] @ self.code[1].T
            most_left, most_right = left.max(axis=1), right.max(axis=1)
            for i in range(len(x)):
                a = np.flatnonzero(left[i] >= self.alpha - most_right[i])
                b = np.flatnonzero(right[i] >= self.alpha - most_left[i])
                both = left[i, a][:, None] + right[i, b]
                limit = self.alpha
                if np.count_nonzero(both >= limit) < least:
                    # The best sums are of the best of either block.
                    a = np.argpartition(-left[i], least - 1)[:least]
                    b = np.argpartition(-right[i], least - 1)[:least]
                    both = left[i, a][:, None] + right[i, b]
                    limit = np.partition(both.reshape(-1), -least)[-least]
                u, v = np.nonzero(both >= limit)
                out.append(a[u] * self.size + b[v])
        return out

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.planes >= 0, axis=1, bitorder="little").view("<i8")


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Unit vectors of equal length; scaled first, so that no square overflows or vanishes."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def filtered(classes: DataFrame, count: int) -> DataFrame:
    """(node, filters, sketch); a filter's number is hashed with the vectors' length."""
    def decode(batches):
        known = {}
        for batch in batches:
            length = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(length).tolist():
                part = batch.take(pa.array(np.flatnonzero(length == d)))
                if d not in known:
                    known[d] = Filters(d, count)
                f = known[d]
                unit = unit_rows(part.column(1))
                found = f.decode(unit)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype("i4")
                values = np.concatenate(found) if found else np.empty(0, "i8")
                filters = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(part), d), pa.int32()), filters,
                     lists(f.sketch(unit))], ["node", "length", "filters", "sketch"])
    return classes.select("node", "vector").mapInArrow(
        decode, "node long, length int, filters array<long>, sketch array<long>")


def cosine_at_least(rows: DataFrame, cosine: float) -> DataFrame:
    """The (a, b) of rows (a, a_vector, b, b_vector) whose cosine reaches the limit."""
    def verify(batches):
        for batch in batches:
            length = np.diff(batch.column(1).offsets.to_numpy())
            keep = np.zeros(len(batch), bool)
            for d in np.unique(length).tolist():
                at = np.flatnonzero(length == d)
                part = batch.take(pa.array(at))
                keep[at] = (unit_rows(part.column(1)) * unit_rows(part.column(3))
                            ).sum(axis=1) >= cosine
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(2).filter(pa.array(keep))],
                ["a", "b"])
    return rows.mapInArrow(verify, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The (a, b) whose vectors are similar, by two joins."""
    v = classes.select("node", "vector")
    rows = (pairs.join(v.toDF("a", "a_vector"), "a").join(v.toDF("b", "b_vector"), "b")
            .select("a", "a_vector", "b", "b_vector"))
    return written(cosine_at_least(rows, cosine), "verified")


def blocked(rows: DataFrame, group: list[str], size: str, left_only: str | None = None
            ) -> DataFrame:
    """Rows dealt to (group, i, j): left block i against right block j. Every row is in each
    right group of its block; left rows (all, or those with ``left_only``) in each left one."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("node"), blocks)
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    other = F.explode(every)
    right = rows.select("*", own.alias("j"), other.alias("i"), F.lit(False).alias("is_left"))
    left = rows.where(left_only) if left_only else rows
    left = left.select("*", own.alias("i"), other.alias("j"), F.lit(True).alias("is_left"))
    return right.unionByName(left)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, left rows, right rows)."""
    table = table.combine_chunks()
    vector = table["vector"].combine_chunks()
    unit = unit_rows(vector.chunk(0) if isinstance(vector, pa.ChunkedArray) else vector)
    is_left = table["is_left"].to_numpy(zero_copy_only=False).astype(bool)
    return unit, np.flatnonzero(is_left), np.flatnonzero(~is_left)


def joining_links(cosine: float):
    """Links between components that two blocks of a bucket hold; a link that joins what an
    earlier one has joined is left out."""
    def compare(table: pa.Table) -> pa.Table:
        unit, left, right = _sides(table)
        node = table["node"].to_numpy()
        _, label = np.unique(table["component"].to_numpy(), return_inverse=True)
        a, b = [], []
        for i in left:
            apart = right[label[right] != label[i]]
            for j in apart[unit[apart] @ unit[i] >= cosine]:
                if label[j] != label[i]:
                    a.append(node[i])
                    b.append(node[j])
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return compare


def counted_links(cosine: float):
    """(node, n): rows that a class is linked with, for left (outer) members and those of the
    right that lie in the core."""
    def compare(table: pa.Table) -> pa.Table:
        unit, left, right = _sides(table)
        node, rows = table["node"].to_numpy(), table["n"].to_numpy()
        core = table["core"].to_numpy(zero_copy_only=False).astype(bool)
        total = np.zeros(len(node), "i8")
        for i in left:
            hit = right[unit[right] @ unit[i] >= cosine]
            hit = hit[node[hit] != node[i]]
            total[i] += rows[hit].sum()
            total[hit[core[hit]]] += rows[i]
        some = np.flatnonzero(total)
        return pa.table({"node": pa.array(node[some], pa.int64()), "n": pa.array(total[some])})
    return compare


def find_components(classes: DataFrame, count: int, cosine: float) -> DataFrame:
    """(node, component) of the classes that have a link."""
    decoded = written(filtered(classes, count), "filters")
    met = decoded.select("node", "sketch", F.explode("filters").alias("filter"), "length") \
        .select("node", "sketch", F.struct("length", "filter").alias("filter"))
    hubs = (met.groupBy("filter").agg(F.min(F.struct("node", "sketch")).alias("hub"),
                                      F.count(F.lit(1)).alias("size")).where("size > 1"))
    met = written(met.join(hubs, "filter"), "met")
    differing = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(
        F.get("hub.sketch", F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0))
    pairs = written(met.where((F.col("node") != F.col("hub.node")) & (differing <= MOST_BITS))
                    .select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(),
                    "pairs")
    links = verified(pairs.groupBy("a").agg(F.min("b").alias("b")), classes, cosine)
    labels = components(links)

    def label(name):
        return labels.toDF(name, f"{name}_found")

    apart = (pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
             .where(~F.coalesce(F.col("a_found") == F.col("b_found"), F.lit(False)))
             .select("a", "b"))
    more = verified(apart, classes, cosine)
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    # What hubs can't decide: members of a bucket, its hub aside, in several components.
    placed = (met.where("size > 2 and node <> hub.node").select("filter", "node", "size")
              .join(labels.toDF("node", "found"), "node", "left")
              .select("filter", "node", "size", F.coalesce("found", "node").alias("component")))
    split = (placed.groupBy("filter").agg(F.min("component").alias("low"),
                                          F.max("component").alias("high"))
             .where("low <> high").select("filter"))
    members = (placed.join(split, "filter")
               .join(classes.select("node", "vector"), "node"))
    new = written(blocked(members, ["filter"], "size").groupBy("filter", "i", "j")
                  .applyInArrow(joining_links(cosine), "a long, b long"), "joining")
    if not new.isEmpty():
        labels = components(links.union(new))
    return labels


def count_links(classes: DataFrame, labels: DataFrame, cosine: float) -> DataFrame:
    """(node, component, n_links): rows linked with a row of the class, for linked classes."""
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    placed = classes.join(labels, "node").select("node", "n", "vector", "component")
    centres = (placed.where("node = component")
               .select("component", F.col("node").alias("b"), F.col("vector").alias("b_vector")))
    core = cosine_at_least(
        placed.select(F.col("node").alias("a"), F.col("vector").alias("a_vector"), "component")
        .join(centres, "component").select("a", "a_vector", "b", "b_vector"), half)
    core = written(core.select(F.col("a").alias("node"), F.lit(True).alias("core")), "core")
    rows = written(placed.join(core, "node", "left").select(
        "node", "n", "component", F.coalesce("core", F.lit(False)).alias("core")), "placed")
    sizes = rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(~F.col("core")).alias("outer"),
        F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_rows"))
    compared = (rows.join(sizes.where("outer > 0").select("component", "size"), "component")
                .join(classes.select("node", "vector"), "node"))
    outer = (blocked(compared, ["component"], "size", "not core").groupBy("component", "i", "j")
             .applyInArrow(counted_links(cosine), "node long, n long")
             .groupBy("node").agg(F.sum("n").alias("linked")))
    return (rows.join(sizes.select("component", "core_rows"), "component")
            .join(outer, "node", "left")
            .select("node", "component",
                    (F.coalesce("linked", F.lit(0)) - 1
                     + F.when(F.col("core"), F.col("core_rows")).otherwise(F.col("n")))
                    .cast("long").alias("n_links")))


def groups(embeddings: DataFrame, cosine: float = COSINE, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """Per row: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id`` (the
    least id that links reach, its own included) and ``kept`` (it is its component's)."""
    if not 0.5 <= cosine < 1:
        raise ValueError("a cosine of at least 0.5 and below 1")
    ship(embeddings.sparkSession)
    v = F.col(vec_col).cast("array<double>")
    usable = finite(v) & F.exists(v, lambda x: x != 0)
    # Two hashes of 64 bits tell vectors apart.
    key = F.when(usable, F.struct(F.xxhash64(v).alias("h"), F.xxhash64(F.lit(1), v).alias("k")))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), key.alias("class"),
                             F.when(usable, v).alias("vector"))
    classes = written(rows.where("class is not null").groupBy("class")
                      .agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"),
                           F.min("vec_id").alias("least"))
                      .withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = find_components(classes, classes.count(), cosine)
    linked = written(count_links(classes, labels, cosine), "linked")
    known = written(classes.select("class", "node", "n", "least").join(linked, "node", "left")
                    .select("class", "n", "least", F.coalesce("component", "node")
                            .alias("component"), F.coalesce("n_links", F.col("n") - 1)
                            .alias("n_links")), "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("class", "n_links", "component_id")
    found = rows.select("vec_id", "class").join(known, "class", "left")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
        .alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
