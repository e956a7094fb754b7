"""Clusters of message embeddings: k-means, silhouettes, summaries, examples.

All models of a sweep, every k with every start, advance together: one job per
iteration sends the centres of the models that still move and brings back sums and counts
per (model, cluster). Starts are drawn by k-means++ in shared passes as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.operators.grouped import top_n_per_group
from deskspark.operators.profile import class_distribution
from deskspark.sources.scratch import freeze

N_INIT = 10
KS = range(5, 13)
MAX_ITERATIONS = 30
# A model stands still when no centre moves farther.
TOLERANCE = 1e-3
# Rows whose distances to all centres a task holds at once, and rows of two tiles that meet at once.
SLICE = 2048
TILE_ROWS = 2048
# Tiles that a table is dealt into (of LEAST_ROWS rows at least), and numbers in the vectors of a tile at most.
TILES = 16
LEAST_ROWS = 256
TILE_VALUES = 1 << 22
# Rows of a tile whose sums travel together.
SUM_ROWS = 64


@dataclass
class Model:
    """Centres with the weight of the rows nearest to each, and the summed squared distance to them."""

    centres: np.ndarray
    sizes: np.ndarray
    cost: float


def points(df: DataFrame, vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """The narrow rows that models are fitted on: vector, weight and a hash for the draw of starts."""
    held = df.where(F.col(vector).isNotNull()).select(
        F.col(vector).cast("array<double>").alias("_vec"),
        (F.col(weight) if weight else F.lit(1)).cast("double").alias("_weight"),
    )
    return held.withColumn("_hash", F.xxhash64("_vec"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            part = batch.slice(first, SLICE)
            flat = part.column(0).flatten().to_numpy(zero_copy_only=False)
            rows = flat.reshape(part.num_rows, -1)
            yield rows, part.column(1).to_numpy(), part.column(2).to_numpy()


def _gaps(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    squares = (rows * rows).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None]
    return np.maximum(squares - 2 * (rows @ centres.T), 0.0)


def _uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) per row and salt, the same wherever the row lies."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64) + np.uint64(salt % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _drawn(chosen: Sequence[np.ndarray], salts: Sequence[int]):
    """Task code: of each start, the row with the largest key log(weight * gap) + Gumbel noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, np.ndarray]] = {}
        for rows, weights, hashes in _matrices(batches):
            for start, (centres, salt) in enumerate(zip(chosen, salts)):
                gap = _gaps(rows, centres).min(axis=1) if len(centres) else np.ones(len(rows))
                if len(centres):
                    gap[gap < 1e-12 * np.maximum((rows * rows).sum(axis=1), 1e-300)] = 0.0
                with np.errstate(divide="ignore"):
                    keys = np.log(weights * gap) - np.log(-np.log(_uniform(hashes, salt)))
                i = int(keys.argmax())
                if np.isfinite(keys[i]) and (start not in best or keys[i] > best[start][0]):
                    best[start] = (float(keys[i]), rows[i].copy())
        yield pa.RecordBatch.from_pydict(
            {
                "start": pa.array(list(best), pa.int32()),
                "key": pa.array([k for k, _ in best.values()], pa.float64()),
                "vec": pa.array([v.tolist() for _, v in best.values()], pa.list_(pa.float64())),
            }
        )

    return run


def starts(held: DataFrame, most: int, seed: int, n_init: int) -> list[np.ndarray]:
    """Per start up to ``most`` centres drawn by k-means++, one job per centre for all starts.

    A draw with chances in proportion to a weight is the largest of log(weight) + Gumbel noise, which
    is a combinable maximum. The first k centres of a start are those of its model with k clusters.
    The noise follows the vector, so equal vectors are drawn like one of them.
    """
    chosen: list[list[np.ndarray]] = [[] for _ in range(n_init)]
    for turn in range(most):
        centres = [np.array(c) for c in chosen]
        salts = [(seed + s) * 1_000_003 + turn for s in range(n_init)]
        drawn = held.mapInArrow(_drawn(centres, salts), "start int, key double, vec array<double>")
        found = drawn.groupBy("start").agg(F.max_by("vec", "key").alias("vec")).collect()
        for row in found:
            chosen[row["start"]].append(np.array(row["vec"]))
        if not found:
            break
    return [np.array(c) for c in chosen]


def _summed(models: Mapping[int, np.ndarray]):
    """Task code: per model and cluster the weight, the cost and the sum of the rows nearest to its centre."""
    names = list(models)
    stacked = np.concatenate([models[m] for m in names])
    ends = np.cumsum([len(models[m]) for m in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, costs = np.zeros_like(stacked), np.zeros(len(stacked)), np.zeros(len(stacked))
        for rows, weights, _ in _matrices(batches):
            gaps = _gaps(rows, stacked)
            weighted = rows * weights[:, None]
            for first, end in zip(np.concatenate(([0], ends[:-1])), ends):
                own = gaps[:, first:end].argmin(axis=1)
                member = np.zeros((len(rows), end - first))
                member[np.arange(len(rows)), own] = 1.0
                sums[first:end] += member.T @ weighted
                sizes[first:end] += member.T @ weights
                costs[first:end] += member.T @ (weights * gaps[np.arange(len(rows)), first + own])
        model = np.repeat(names, [len(models[m]) for m in names])
        place = np.concatenate([np.arange(len(models[m])) for m in names])
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_pydict(
            {
                "model": pa.array(model[used], pa.int32()),
                "cluster": pa.array(place[used], pa.int32()),
                "size": sizes[used],
                "cost": costs[used],
                "total": pa.array(sums[used].tolist(), pa.list_(pa.float64())),
            }
        )

    return run


def cluster_sums(held: DataFrame, models: Mapping[int, np.ndarray]) -> DataFrame:
    """(model, cluster, size, cost, total) of the rows nearest to each centre, for all models in one pass."""
    parts = held.mapInArrow(_summed(models), "model int, cluster int, size double, cost double, total array<double>")
    return parts.groupBy("model", "cluster").agg(
        F.sum("size").alias("size"),
        F.sum("cost").alias("cost"),
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
    )


def advance(
    held: DataFrame,
    begin: Mapping[int, np.ndarray],
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
) -> dict[int, Model]:
    """Lloyd's iterations of all models side by side, one job each; a model that stands still drops out.

    What travels is every centre of the models that move. A centre without rows stays where it is.
    """
    centres = {m: np.asarray(c, dtype=np.float64) for m, c in begin.items()}
    moving = dict(centres)
    for _ in range(max_iterations):
        if not moving:
            break
        moved = {m: c.copy() for m, c in moving.items()}
        for row in cluster_sums(held, moving).collect():
            moved[row["model"]][row["cluster"]] = np.array(row["total"]) / row["size"]
        centres.update(moved)
        moving = {
            m: c for m, c in moved.items() if np.sqrt(((c - moving[m]) ** 2).sum(axis=1)).max() > tolerance
        }
    sizes, costs = {m: np.zeros(len(c)) for m, c in centres.items()}, dict.fromkeys(centres, 0.0)
    for row in cluster_sums(held, centres).drop("total").collect():
        sizes[row["model"]][row["cluster"]] = row["size"]
        costs[row["model"]] += row["cost"]
    return {m: Model(c, sizes[m], costs[m]) for m, c in centres.items()}


def fit_many(
    held: DataFrame, ks: Sequence[int], seed: int, n_init: int = N_INIT, max_iterations: int = MAX_ITERATIONS
) -> dict[int, Model]:
    """Per k the model of least cost among ``n_init`` starts; the earliest wins a tie.

    ``held`` comes from :func:`points`; it is stored once, in narrow rows, and read by every pass. No rows: no models.
    Fewer distinct rows than k: as many clusters as there are.
    """
    held = freeze(held)
    drawn = [c for c in starts(held, max(ks), seed, n_init) if len(c)]
    if not drawn:
        return {}
    names = [(k, s) for k in ks for s in range(len(drawn))]
    fitted = advance(held, {i: drawn[s][:k] for i, (k, s) in enumerate(names)}, max_iterations)
    # Costs are compared to nine digits, since sums over partitions differ in the last ones.
    return {
        k: fitted[min((i for i, n in enumerate(names) if n[0] == k), key=lambda i: (float(f"{fitted[i].cost:.9g}"), i))]
        for k in ks
    }


def fit_centres(
    df: DataFrame, k: int, seed: int, n_init: int = 1, vector: str = "embedding", max_iterations: int = 10
) -> np.ndarray | None:
    """Centres of one model for cells, where some iterations do; None for a table without vectors."""
    found = fit_many(points(df, vector), [k], seed, n_init, max_iterations)
    return found[k].centres if found else None


def nearest(centres: np.ndarray, n: int = 1):
    """Pandas UDF: the ``n`` centres nearest to a vector, nearest first."""
    squares = (centres * centres).sum(axis=1)

    @F.pandas_udf("array<int>")
    def found(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        gaps = squares - 2 * (np.stack(vectors.to_numpy()).astype(np.float64) @ centres.T)
        return pd.Series(list(np.argsort(gaps, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return found


def assign(df: DataFrame, models: Mapping[str, Model], vector: str = "embedding") -> DataFrame:
    """Add a column per named model: the cluster of each row that has a vector."""
    held = df.where(F.col(vector).isNotNull())
    return held.withColumns({name: F.get(nearest(m.centres)(F.col(vector)), F.lit(0)) for name, m in models.items()})


def kmeans(
    df: DataFrame, k: int, seed: int = 42, n_init: int = N_INIT, vector: str = "embedding", model: Model | None = None
) -> DataFrame:
    """Add ``cluster`` (0..k-1) by a fitted model, or one fitted on this table."""
    model = model or fit_many(points(df, vector), [k], seed, n_init).get(k)
    if model is None:
        return df.limit(0).withColumn("cluster", F.lit(0))
    return assign(df, {"cluster": model}, vector)


def with_vectors(df: DataFrame, vector: str = "embedding", output: str = "features") -> DataFrame:
    return df.where(F.col(vector).isNotNull()).withColumn(
        output, array_to_vector(F.col(vector).cast("array<double>"))
    )


def silhouette(df: DataFrame, cluster: str = "cluster", features: str = "features", metric: str = "squaredEuclidean") -> float:
    """Mean silhouette in one linear pass, on squared Euclidean or cosine distance."""
    evaluator = ClusteringEvaluator(predictionCol=cluster, featuresCol=features, distanceMeasure=metric)
    return evaluator.evaluate(df)


def silhouettes_squared(held: DataFrame, models: Mapping[int, Model]) -> dict[int, float | None]:
    """Mean silhouette on squared distance of each model's own clusters, weighted, in one linear pass.

    The mean squared distance of a row to a cluster follows from the cluster's weight, centre and cost.
    """
    means, spread = {}, {}
    for row in cluster_sums(held, {m: x.centres for m, x in models.items()}).collect():
        own = np.array(row["total"]) / row["size"]
        means.setdefault(row["model"], {})[row["cluster"]] = own
        # The cost is about the centre the rows were assigned by; about their mean it is less.
        off = ((own - models[row["model"]].centres[row["cluster"]]) ** 2).sum()
        spread.setdefault(row["model"], {})[row["cluster"]] = (row["size"], max(row["cost"] / row["size"] - off, 0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = dict.fromkeys(means, 0.0)
        weight = 0.0
        for rows, weights, _ in _matrices(batches):
            weight += weights.sum()
            for m in means:
                kept = sorted(means[m])
                own = _gaps(rows, models[m].centres[kept]).argmin(axis=1)
                size = np.array([spread[m][c][0] for c in kept])
                mean = _gaps(rows, np.array([means[m][c] for c in kept])) + np.array([spread[m][c][1] for c in kept])
                at = np.arange(len(rows))
                inside = mean[at, own] * size[own] / np.maximum(size[own] - 1, 1e-300)
                mean[at, own] = np.inf
                outside = mean.min(axis=1)
                largest = np.maximum(inside, outside)
                found = np.where((size[own] > 1) & (largest > 0), (outside - inside) / np.where(largest > 0, largest, 1), 0.0)
                sums[m] += float((weights * found).sum())
        yield pa.RecordBatch.from_pydict(
            {"model": pa.array(list(sums), pa.int32()), "score": list(sums.values()), "weight": [weight] * len(sums)}
        )

    wide = {m: len(x) for m, x in means.items()}
    parts = held.mapInArrow(score, "model int, score double, weight double")
    found = parts.groupBy("model").agg((F.sum("score") / F.sum("weight")).alias("mean")).collect()
    return {m: None for m in models} | {r["model"]: r["mean"] for r in found if wide[r["model"]] > 1}


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Task code: the rows of one block in, one row with their matrix and labels out."""
    vectors = table.column("_vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    labels = table.column("_labels").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return pa.table(
        {"block": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([table.num_rows], pa.int64()),
         "vectors": [vectors.astype("<f8").tobytes()], "labels": [labels.astype("<i4").tobytes()]}
    )


def _met(widths: Sequence[int], step: int):
    """Task code: two tiles in; for the rows of both, sums of distances to the other's clusters out."""
    whole = int(sum(widths))
    offsets = np.concatenate(([0], np.cumsum(widths)[:-1])).astype(np.int64)
    names = ["block", "slice", "sums", "labels"]

    def opened(tile: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        row = tile.to_pylist()[0]
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(row["rows"], -1)
        labels = np.frombuffer(row["labels"], "<i4").reshape(row["rows"], -1)
        member = np.zeros((row["rows"], whole))
        member[np.arange(row["rows"])[:, None], labels + offsets] = 1.0
        return row["block"], vectors, labels, member

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        i, x, x_labels, x_member = opened(left)
        j, y, y_labels, y_member = opened(right)
        x_sums, y_sums = np.zeros_like(x_member), np.zeros_like(y_member)
        for a in range(0, len(x), step):
            for b in range(0, len(y), step):
                gaps = np.sqrt(_gaps(x[a : a + step], y[b : b + step]))
                if i == j and a == b:
                    np.fill_diagonal(gaps, 0.0)
                x_sums[a : a + step] += gaps @ y_member[b : b + step]
                if i != j:
                    y_sums[b : b + step] += gaps.T @ x_member[a : a + step]
        out = [(i, x_sums, x_labels if i == j else None)]
        if i != j:
            out.append((j, y_sums, None))
        rows = [
            (block, at, sums[at : at + SUM_ROWS].tobytes(), None if labels is None else labels[at : at + SUM_ROWS].tobytes())
            for block, sums, labels in out
            for at in range(0, len(sums), SUM_ROWS)
        ]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return meet


def _scores(sizes: Sequence[Sequence[int]]):
    """Task code: partial sums in order of their rows in, summed silhouettes per labelling out."""
    counts = [np.array(s, np.float64) for s in sizes]
    ends = np.cumsum([len(s) for s in sizes])

    def score(sums: np.ndarray, labels: np.ndarray) -> np.ndarray:
        out = np.zeros(len(counts))
        at = np.arange(len(sums))
        for n, (size, end) in enumerate(zip(counts, ends)):
            own, part = labels[:, n], sums[:, end - len(size) : end].copy()
            inside = part[at, own] / np.maximum(size[own] - 1, 1)
            part /= size
            part[at, own] = np.inf
            outside = part.min(axis=1)
            largest = np.maximum(inside, outside)
            good = (size[own] > 1) & (largest > 0) & np.isfinite(outside)
            out[n] = np.where(good, (outside - inside) / np.where(good, largest, 1.0), 0.0).sum()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at, sums, labels = np.zeros(len(counts)), None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                part = np.frombuffer(row["sums"], "<f8").reshape(-1, int(ends[-1]))
                if (row["block"], row["slice"]) != at:
                    if at is not None:
                        total += score(sums, labels)
                    at, sums, labels = (row["block"], row["slice"]), part.copy(), None
                else:
                    sums += part
                if row["labels"] is not None:
                    labels = np.frombuffer(row["labels"], "<i4").reshape(len(part), -1)
        if at is not None:
            total += score(sums, labels)
        yield pa.RecordBatch.from_pydict({"labelling": pa.array(range(len(counts)), pa.int32()), "score": total})

    return run


def silhouette_exact(
    df: DataFrame, clusters: Sequence[str], vector: str = "embedding", tile_rows: int = TILE_ROWS
) -> dict[str, float | None]:
    """Mean silhouette on plain Euclidean distance over all rows, for several labellings (integer columns) at once.

    Rows are dealt into up to TILES tiles, or as many as hold TILE_VALUES numbers each; every two tiles meet once,
    ``tile_rows`` by ``tile_rows`` rows, and give, per row, one sum of distances per cluster, never a pair; sums are
    added by row. The work is the square of the rows times the dimensions, shared by all labellings; a vector and
    a row of sums are shuffled once per tile, and a task holds two tiles however many rows there are.
    Rows without a vector or a label are left out. Fewer than two clusters: None.
    """
    every = [F.col(vector).isNotNull(), *[F.col(c).isNotNull() for c in clusters]]
    held = df
    for one in every:
        held = held.where(one)
    held = freeze(
        held.select(
            F.col(vector).cast("array<double>").alias("_vec"),
            *[F.col(c).cast("int").alias(f"_label{i}") for i, c in enumerate(clusters)],
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    rows, values = held.agg(F.count(F.lit(1)), F.sum(F.size("_vec"))).first()
    if not rows:
        return dict.fromkeys(clusters)
    # Cluster numbers become 0, 1, ...; their sizes are one row per cluster.
    known = [
        {r[0]: r[1] for r in held.groupBy(f"_label{i}").count().orderBy(f"_label{i}").collect()} for i in range(len(clusters))
    ]
    place = [
        F.element_at(F.create_map(*[F.lit(x) for pair in zip(k, range(len(k))) for x in pair]), F.col(f"_label{i}"))
        for i, k in enumerate(known)
    ]
    blocks = max(min(-(-rows // min(tile_rows, LEAST_ROWS)), TILES), -(-values // TILE_VALUES))
    dealt = held.select(
        "_vec", F.array(*place).alias("_labels"), F.pmod(F.xxhash64("_at"), F.lit(blocks)).alias("block")
    )
    tiles = freeze(dealt.groupBy("block").applyInArrow(_tile, "block bigint, rows bigint, vectors binary, labels binary"))
    left = tiles.select("*", F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"))
    right = tiles.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block"))).alias("i"), F.col("block").alias("j"))
    widths = [len(k) for k in known]
    meet = _met(widths, tile_rows)

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:  # a block without rows
            return pa.schema([("block", pa.int64()), ("slice", pa.int64()), ("sums", pa.binary()), ("labels", pa.binary())]).empty_table()
        return meet(a, b)

    sums = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(
        met, "block bigint, slice bigint, sums binary, labels binary"
    )
    ordered = sums.repartition("block", "slice").sortWithinPartitions("block", "slice")
    parts = ordered.mapInArrow(_scores([list(k.values()) for k in known]), "labelling int, score double")
    found = {r[0]: r[1] / rows for r in parts.groupBy("labelling").agg(F.sum("score")).collect()}
    return {c: found[i] if widths[i] > 1 else None for i, c in enumerate(clusters)}


def sweep_k(
    df: DataFrame,
    ks: Sequence[int] = KS,
    seed: int = 42,
    n_init: int = N_INIT,
    vector: str = "embedding",
    metric: str = "euclidean",
    weight: str | None = None,
    models: Mapping[int, Model] | None = None,
) -> DataFrame:
    """One row per k: silhouette, training cost and whether k is the best (the least k of equals).

    ``metric='euclidean'`` is the exact silhouette, at a cost of rows times rows; ``'squared'`` takes one linear
    pass. With ``weight`` a row stands for as many copies (squared metric only).
    """
    if metric not in ("euclidean", "squared") or weight and metric == "euclidean":
        raise ValueError("metric is 'euclidean' or, also for weighted rows, 'squared'")
    held = points(df, vector, weight)
    models = fit_many(held, ks, seed, n_init) if models is None else models
    if metric == "squared":
        scores = silhouettes_squared(held, models) if models else {}
    else:
        names = {f"_k{k}": m for k, m in models.items()}
        found = silhouette_exact(assign(df.select(vector), names, vector), list(names), vector) if models else {}
        scores = {k: found[f"_k{k}"] for k in models}
    known = [(round(s, 9), -k) for k, s in scores.items() if s is not None]
    best = -max(known)[1] if known else None
    table = [(int(k), scores[k], float(m.cost), k == best) for k, m in models.items()]
    return df.sparkSession.createDataFrame(table, "k int, silhouette double, training_cost double, best boolean")


def cluster_summary(df: DataFrame, cluster: str = "cluster", weight: str | None = None) -> DataFrame:
    """Size and percentage per cluster; with ``weight`` a row stands for as many copies."""
    if weight:
        sizes = df.groupBy(cluster).agg(F.sum(weight).cast("bigint").alias("size"))
        total = df.agg(F.sum(weight)).scalar()
        return sizes.withColumn("percentage", F.col("size") / total * 100)
    return class_distribution(df, cluster).select(
        cluster, F.col("n").alias("size"), (F.col("share") * 100).alias("percentage")
    )


def cluster_examples(df: DataFrame, order: Sequence[Column], n: int = 5, cluster: str = "cluster") -> DataFrame:
    """The first n rows of each cluster."""
    return top_n_per_group(df, [cluster], order, n)
