"""Top-k retrieval by dot product, without materialising pairs.

Corpus slices and query chunks of bounded size meet in groups that emit k rows
per query and slice; inside a group the corpus is read in blocks. ``knn`` lets every chunk meet every slice of its
partition value and is exact, at a cost of queries times corpus rows. ``knn_cells`` cuts
the corpus into k-means cells and searches the nearest ones only. ``knn_codes``
scans product-quantised codes of a few bytes per row and reads full vectors for a
short list only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from deskspark.lexicon import NO_CONTEXT
from deskspark.operators import cluster
from deskspark.operators.grouped import top_n_per_group
from deskspark.sources.scratch import freeze

# Corpus rows that a task multiplies with at once.
BLOCK_ROWS = 4096
# Chunks that the queries of a partition value are cut into (of CHUNK_ROWS rows at least), and numbers in the vectors
# of a chunk or slice at most. A corpus row travels once per chunk, a query once per slice: a fixed
# number of times until CHUNKS * SLICE_VALUES numbers.
CHUNKS = 32
CHUNK_ROWS = 256
SLICE_VALUES = 1 << 22
# Scores that a task holds at once.
SCORES = 1 << 21
# Tasks over which the rows of one partition value are dealt when they look up its layout.
SALTS = 64
# Rows that k-means cells are fitted on at most; all rows are then assigned.
FIT_ROWS = 20_000
# Starts of the cells' model, the one of least cost is taken: tighter cells lose fewer neighbours.
CELL_STARTS = 8
# Similarities are rounded before ranking so that equal vectors tie exactly.
DIGITS = 9
# Columns of a score matrix that share one maximum: a row is looked at closer only where that reaches its bound.
FOLD = 16
# Numbers gathered at once for the exact products of single pairs.
GATHERED = 1 << 20
# Products below which double precision holds the digits that similarities are rounded to, so that it does not matter how they are summed.
SCREENED = 1e4


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(rows, -1)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indexes of the k best per row; equal scores prefer the earlier column."""
    width = scores.shape[1]
    if width > k:
        floor = np.partition(scores, width - k, axis=1)[:, width - k, None]
        above, level = scores > floor, scores == floor
        room = k - above.sum(axis=1, keepdims=True)
        rows, cols = np.nonzero(above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= room)))
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    return rows, cols


def _leading(
    rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int, count: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k first hits per row, and per row the score that a later hit must exceed."""
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    floor = np.full(count, -np.inf)
    floor[rows[place == k - 1]] = scores[place == k - 1]
    return rows[place < k], cols[place < k], scores[place < k], floor


def _search(
    wanted: np.ndarray, corpus: np.ndarray, k: int, block_rows: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of queries: its offset, and row, column and score of each hit.

    The corpus is read block by block. Blocks are screened by products in single precision, less what these may be
    off by; the pairs left are multiplied in double precision and ranked, so the hits are exact.
    """
    if not _length(wanted).max(initial=0.0) * _length(corpus).max(initial=0.0) < SCREENED:
        yield from _search_wide(wanted, corpus, k, block_rows)
        return
    step, width = max(1, SCORES // block_rows), -(-block_rows // FOLD) * FOLD
    # Rounding of the numbers and of each sum, twice what it may come to; and that of the similarities.
    off = _length(wanted) * _length(corpus).max(initial=0.0) * (corpus.shape[1] + 8) * 2.0**-23 + 10.0**-DIGITS
    small, light = wanted.astype(np.float32), np.zeros((-(-len(corpus) // FOLD) * FOLD, corpus.shape[1]), np.float32)
    light[: len(corpus)] = corpus
    for start in range(0, len(wanted), step):
        asked, slack = wanted[start : start + step], off[start : start + step]
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        floor = np.full(len(asked), -np.inf)
        for first in range(0, len(corpus), width):
            block = corpus[first : first + width]
            rough = small[start : start + step] @ light[first : first + width].T
            rough[:, len(block) :] = -np.inf
            rows, cols = _screened(rough, len(block), k, floor - slack, slack)
            if len(rows) * 8 > rough.size:
                # Most pairs are near the bound, as with copies.
                whole = asked @ block.T
                if first == 0:
                    whole = np.round(whole, DIGITS) + 0.0
                    rows, cols = _best(whole, k)
                else:
                    rows, cols = np.nonzero(whole >= (floor + 0.4 * 10.0**-DIGITS)[:, None])
                scores = np.round(whole[rows, cols], DIGITS) + 0.0
            else:
                scores = np.round(_products(asked, block, rows, cols), DIGITS) + 0.0
            # Equal scores prefer the earlier column, so a later one must exceed the k-th so far.
            above = scores > floor[rows]
            if above.any():
                found = [np.concatenate(x) for x in zip(held, (rows[above], cols[above] + first, scores[above]))]
                *held, floor = _leading(*found, k, len(asked))
        yield start, *held


def _length(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def _screened(
    rough: np.ndarray, width: int, k: int, least: np.ndarray, slack: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of scores that may be among the k best and reach ``least``; the columns from ``width`` on are no rows."""
    rows, folds = len(rough), rough.shape[1] // FOLD
    tops = rough.reshape(rows, FOLD, folds).max(axis=1)
    if width > k and np.isneginf(least).any():
        # The k-th of the maxima is no more than the k-th score.
        ranked = tops if folds >= k else rough
        kth = np.partition(ranked, ranked.shape[1] - k, axis=1)[:, ranked.shape[1] - k]
        least = np.maximum(least, kth - 2 * slack)
    least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
    row, fold = np.divmod(np.flatnonzero(tops >= least[:, None]), folds)
    if len(row) * 8 > tops.size:
        row, col = np.nonzero(rough[:, :width] >= least[:, None])
        return row, col
    cols = fold[:, None] + folds * np.arange(FOLD)
    near = (rough[row[:, None], cols] >= least[row][:, None]) & (cols < width)
    return np.repeat(row, near.sum(axis=1)), cols[near]


def _products(asked: np.ndarray, block: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Dot products of single pairs."""
    step = max(1, GATHERED // max(1, block.shape[1]))
    parts = [
        np.einsum("ij,ij->i", asked[rows[i : i + step]], block[cols[i : i + step]]) for i in range(0, len(rows), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def _search_wide(
    wanted: np.ndarray, corpus: np.ndarray, k: int, block_rows: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`_search` for numbers that single precision does not hold, missing ones included."""
    step = max(1, SCORES // block_rows)
    for start in range(0, len(wanted), step):
        asked, held, floor = wanted[start : start + step], None, None
        for first in range(0, len(corpus), block_rows):
            scores = asked @ corpus[first : first + block_rows].T
            if held is None:
                scores = np.round(scores, DIGITS) + 0.0
                rows, cols = _best(scores, k)
                found = rows, cols, scores[rows, cols]
            else:
                # Rounding lifts a score by less than what is taken off here.
                rows, cols = np.nonzero(scores >= (floor - 1e-8 - 1e-14 * np.abs(floor))[:, None])
                near = np.round(scores[rows, cols], DIGITS) + 0.0
                above = near > floor[rows]
                if not above.any():
                    continue
                found = [np.concatenate(x) for x in zip(held, (rows[above], cols[above] + first, near[above]))]
            *held, floor = _leading(*found, k, len(asked))
        yield start, *held


def _id_types(queries: DataFrame, corpus: DataFrame) -> list[DataType]:
    return [queries.schema["_qid"].dataType, corpus.schema["_cid"].dataType]


def _hit_schema(queries: DataFrame, corpus: DataFrame) -> pa.Schema:
    query, found = map(to_arrow_type, _id_types(queries, corpus))
    return pa.schema([("_qid", query), ("_cid", found), ("similarity", pa.float64())])


def _ddl(queries: DataFrame, corpus: DataFrame) -> str:
    query, found = (t.simpleString() for t in _id_types(queries, corpus))
    return f"_qid {query}, _cid {found}, similarity double"


def _search_block(k: int, schema: pa.Schema, block_rows: int, decoded=_matrix):
    """Cogroup body: a bounded query chunk against a bounded corpus slice, whose vectors ``decoded`` gives."""

    def search(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or corpus.num_rows == 0:
            return schema.empty_table()
        corpus = corpus.sort_by([("_cid", "descending")])
        block = decoded(corpus.column("_vec"), corpus.num_rows)
        wanted = _matrix(queries.column("_vec"), queries.num_rows)
        found = [
            pa.table(
                {
                    "_qid": queries.column("_qid").take(pa.array(rows + start)),
                    "_cid": corpus.column("_cid").take(pa.array(cols)),
                    "similarity": pa.array(scores),
                }
            ).cast(schema)
            for start, rows, cols, scores in _search(wanted, block, k, block_rows)
        ]
        return pa.concat_tables(found)

    return search


def numbers(rows: DataFrame, vector: str) -> Column:
    """The vectors as doubles, or as they are where floats hold them."""
    return F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")


def _asked(queries: DataFrame, query_id: str, vector: str, part) -> DataFrame:
    return queries.where(F.col(vector).isNotNull() & part.isNotNull()).select(
        F.col(query_id).alias("_qid"), numbers(queries, vector).alias("_vec"), part.alias("_part")
    )


def _base(corpus: DataFrame, corpus_id: str, vector: str, part) -> DataFrame:
    return corpus.where(F.col(vector).isNotNull() & part.isNotNull()).select(
        F.col(corpus_id).alias("_cid"), numbers(corpus, vector).alias("_vec"), part.alias("_part")
    )


def _search_parts(
    asked: DataFrame, base: DataFrame, k: int, block_rows: int, decoded=_matrix, dims: Column | None = None
) -> DataFrame:
    """Hits of every query in every corpus slice of its partition value.

    A value's queries are cut into up to CHUNKS chunks, or as many as hold SLICE_VALUES numbers each, its corpus
    rows into slices of SLICE_VALUES numbers: both sides of a group are bounded however the rows are
    spread over the values, and few copies of a row travel. ``dims`` is the width of a corpus vector that is not an array.
    """
    rows = F.count(F.lit(1))

    def slices(width: Column) -> Column:
        return F.ceil(F.sum(width) / F.lit(SLICE_VALUES))

    some = F.least(F.lit(CHUNKS), F.ceil(rows / F.lit(CHUNK_ROWS)))
    chunks = asked.groupBy("_part").agg(F.greatest(some, slices(F.size("_vec"))).cast("int").alias("_chunks"))
    width = F.size("_vec") if dims is None else dims
    blocks = base.groupBy("_part").agg(F.greatest(F.lit(1), slices(width)).cast("int").alias("_blocks"))
    layout = chunks.join(blocks, "_part").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def placed(rows: DataFrame, key: str, own: str, own_slices: str, other: str, other_slices: str) -> DataFrame:
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(SALTS)).cast("int"))
        return dealt.join(layout, ["_part", "_salt"]).select(
            "_part",
            key,
            "_vec",
            F.pmod(F.xxhash64(key), F.col(own_slices)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_slices) - 1)).alias(other),
        )

    left = placed(asked, "_qid", "_chunk", "_chunks", "_block", "_blocks")
    right = placed(base, "_cid", "_block", "_blocks", "_chunk", "_chunks")
    group = ["_part", "_chunk", "_block"]
    search = _search_block(k, _hit_schema(asked, base), block_rows, decoded)
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(search, _ddl(asked, base))


def _ranked(hits: DataFrame, k: int, query_id: str, corpus_id: str) -> DataFrame:
    best = top_n_per_group(hits, ["_qid"], [F.desc("similarity"), F.desc("_cid")], k)
    return best.select(F.col("_qid").alias(query_id), F.col("_cid").alias(corpus_id), "similarity", "rank")


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    query_id: str = "query_id",
    corpus_id: str = "corpus_id",
    vector: str = "embedding",
    partition: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, corpus_id, similarity, rank): the k corpus rows with the largest dot product.

    Ties go to the larger id. With ``partition`` a query only sees corpus rows
    of its own partition value. Exact: the work is queries times corpus rows;
    :func:`knn_cells` is the way for two large sides.
    """
    part = F.col(partition).cast("string") if partition else F.lit("")
    asked, base = _asked(queries, query_id, vector, part), _base(corpus, corpus_id, vector, part)
    return _ranked(_search_parts(asked, base, k, block_rows), k, query_id, corpus_id)


def search_cells(
    asked: DataFrame, base: DataFrame, k: int, query_id: str, corpus_id: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The k best of rows (_cid, _vec, _part) for queries (_qid, _vec, _part) that share their cell."""
    return _ranked(_search_parts(asked, base, k, block_rows), k, query_id, corpus_id)


def fitting_rows(held: DataFrame, key: str, seed: int, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` rows in seeded order, which cells and codebooks are fitted on."""
    return held.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(rows)


def knn_cells(
    queries: DataFrame,
    corpus: DataFrame,
    cells: int,
    probes: int,
    k: int = 3,
    query_id: str = "query_id",
    corpus_id: str = "corpus_id",
    vector: str = "embedding",
    seed: int = 42,
    fit_rows: int = FIT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Like :func:`knn`, searching the ``probes`` nearest of ``cells`` k-means cells per query.

    Centres are fitted on at most ``fit_rows`` rows in seeded order; every corpus
    row is then put in its nearest cell. ``probes = cells`` is exact, fewer
    probes lose some neighbours: measure the recall on your vectors. A cell of any size is
    cut into blocks. Only the centres reach the driver.
    """
    held = corpus.where(F.col(vector).isNotNull())
    centres = cluster.fit_centres(fitting_rows(held, corpus_id, seed, fit_rows), cells, seed, CELL_STARTS, vector)
    if centres is None:
        return knn(queries, corpus, k, query_id, corpus_id, vector)
    base = _base(held, corpus_id, vector, F.lit("")).withColumn(
        "_part", F.get(cluster.nearest(centres)("_vec"), F.lit(0))
    )
    asked = _asked(queries, query_id, vector, F.lit("")).withColumn(
        "_part", F.explode(cluster.nearest(centres, probes)("_vec"))
    )
    return _ranked(_search_parts(asked, base, k, block_rows), k, query_id, corpus_id)


@dataclass(frozen=True)
class Codes:
    """Product quantiser: a cell's centre, then per subspace the nearest of at most 256 sub-vectors of what is left."""

    centres: np.ndarray
    books: list[np.ndarray]

    def _padded(self, rows: np.ndarray) -> np.ndarray:
        width = sum(b.shape[1] for b in self.books)
        return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, bytes: the cell and a code per subspace) of each row."""
        cells = (((self.centres**2).sum(axis=1)) - 2 * rows @ self.centres.T).argmin(axis=1)
        left = self._padded(rows - self.centres[cells])
        out, at = [cells.astype("<i4").view(np.uint8).reshape(-1, 4)], 0
        for book in self.books:
            part = left[:, at : at + book.shape[1]]
            at += book.shape[1]
            out.append(((book**2).sum(axis=1) - 2 * part @ book.T).argmin(axis=1).astype(np.uint8)[:, None])
        return cells, np.concatenate(out, axis=1)

    def decode(self, column: pa.ChunkedArray, rows: int) -> np.ndarray:
        """Vectors that codes stand for; their product with a query is the sum of its table of distances."""
        data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, 4 + len(self.books))
        cells = data[:, :4].copy().view("<i4")[:, 0]
        left = np.concatenate([book[data[:, 4 + i]] for i, book in enumerate(self.books)], axis=1)
        return self.centres[cells] + left[:, : self.centres.shape[1]]

    def column(self, vector: Column) -> Column:
        """Pandas UDF: (cell, code) of a vector."""
        codes = self

        @F.pandas_udf("cell int, code binary")
        def encoded(vectors: pd.Series) -> pd.DataFrame:
            if len(vectors) == 0:
                return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "code": pd.Series([], dtype=object)})
            cells, data = codes.encode(np.stack(vectors.to_numpy()).astype(np.float64))
            return pd.DataFrame({"cell": cells.astype(np.int32), "code": [x.tobytes() for x in data]})

        return encoded(vector)


def _codebook(seed: int, codes: int, rounds: int):
    """Task code: sub-vectors of one subspace in, the means of ``codes`` groups of them out."""

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = np.unique(_matrix(table.column("_part"), table.num_rows), axis=0)
        book = rows[np.random.default_rng([seed, key[0].as_py()]).permutation(len(rows))[:codes]]
        for _ in range(rounds):
            own = ((book**2).sum(axis=1) - 2 * rows @ book.T).argmin(axis=1)
            sums = np.zeros_like(book)
            np.add.at(sums, own, rows)
            size = np.bincount(own, minlength=len(book))
            book = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], book)
        return pa.table({"_sub": pa.array([key[0].as_py()], pa.int32()), "_book": [book.tolist()]})

    return fit


def fit_codes(
    corpus: DataFrame, cells: int, corpus_id: str = "corpus_id", vector: str = "embedding", subspaces: int = 16,
    codes: int = 256, seed: int = 42, fit_rows: int = FIT_ROWS, rounds: int = 12,
) -> Codes | None:
    """Fit a product quantiser on at most ``fit_rows`` rows, one task per subspace; None without vectors.

    What reaches the driver: the cells' centres and ``codes`` sub-vectors per subspace.
    """
    held = corpus.where(F.col(vector).isNotNull()).withColumn(vector, F.col(vector).cast("array<double>"))
    sample = freeze(fitting_rows(held.select(corpus_id, vector), corpus_id, seed, fit_rows))
    centres = cluster.fit_centres(sample, cells, seed, 1, vector)
    if centres is None:
        return None
    width = -(-centres.shape[1] // subspaces)

    @F.pandas_udf("array<array<double>>")
    def parts(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        rows = np.stack(vectors.to_numpy())
        left = rows - centres[((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)]
        left = np.pad(left, ((0, 0), (0, width * subspaces - left.shape[1])))
        return pd.Series([[list(p) for p in row] for row in left.reshape(len(rows), subspaces, width)])

    spread = sample.select(F.posexplode(parts(F.col(vector))).alias("_sub", "_part"))
    books = spread.groupBy("_sub").applyInArrow(_codebook(seed, codes, rounds), "_sub int, _book array<array<double>>")
    found = {r["_sub"]: np.array(r["_book"]) for r in books.collect()}
    return Codes(centres, [found[i] for i in range(subspaces)])


def knn_codes(
    queries: DataFrame,
    corpus: DataFrame,
    cells: int,
    probes: int,
    short_list: int,
    k: int = 3,
    query_id: str = "query_id",
    corpus_id: str = "corpus_id",
    vector: str = "embedding",
    codes: Codes | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Like :func:`knn` over two large sides: codes are scanned, full vectors are read for short lists only.

    Every corpus row is coded in some bytes and lies in its nearest cell. A query scans the codes of
    its ``probes`` nearest cells, and the ``short_list`` best by code are ranked by their full vectors: the
    pairs shuffled with vectors are queries times ``short_list``. A list that has room for all rows of its cells cuts
    none: such queries meet the cells' full vectors in groups, and no pair is shuffled. ``probes = cells`` and a short
    list of the whole corpus are exact; otherwise measure the recall on your vectors.
    """
    codes = codes or fit_codes(corpus, cells, corpus_id, vector)
    if codes is None:
        return knn(queries, corpus, k, query_id, corpus_id, vector)
    base = _base(corpus, corpus_id, vector, F.lit("")).select(
        "_cid", F.col("_vec").alias("_own"), codes.column(F.col("_vec").cast("array<double>")).alias("_c")
    )
    base = freeze(base.select("_cid", "_own", F.col("_c.code").alias("_code"), F.col("_c.cell").alias("_part")))
    sizes = {r["_part"]: r["count"] for r in base.groupBy("_part").count().collect()}
    held = F.array(*[F.lit(sizes.get(i, 0)).cast("bigint") for i in range(len(codes.centres))])
    asked = _asked(queries, query_id, vector, F.lit("")).where("_qid IS NOT NULL").drop("_part")
    asked = asked.withColumn("_cells", cluster.nearest(codes.centres, probes)("_vec"))
    probed = F.aggregate("_cells", F.lit(0).cast("bigint"), lambda acc, cell: acc + F.get(held, cell))
    # Rows that share a query id share its list.
    room = probed * F.count(F.lit(1)).over(Window.partitionBy("_qid"))
    asked = freeze(asked.withColumn("_cut", room > short_list))
    if probes < len(codes.centres):
        cells_of = ["_qid", "_vec", F.explode("_cells").alias("_part")]
    else:
        # Every query meets every cell: one part, where a query travels and is listed once per slice, not per cell.
        cells_of = ["_qid", "_vec", F.lit(0).alias("_part")]
        base = base.withColumn("_part", F.lit(0))
    listed = top_n_per_group(
        _search_parts(
            asked.where("_cut").select(*cells_of), base.select("_cid", F.col("_code").alias("_vec"), "_part"),
            short_list, block_rows, codes.decode, F.lit(codes.centres.shape[1]),
        ),
        ["_qid"], [F.desc("similarity"), F.desc("_cid")], short_list,
    ).select("_qid", "_cid")
    product = F.aggregate(
        F.zip_with("_vec", "_own", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )
    ranked = (
        listed.join(base.select("_cid", "_own"), "_cid")
        .join(asked.where("_cut").select("_qid", "_vec"), "_qid")
        .select("_qid", "_cid", (F.round(product, DIGITS) + F.lit(0.0)).alias("similarity"))
    )
    rows = base.where("_cid IS NOT NULL").select("_cid", F.col("_own").alias("_vec"), "_part")
    whole = _search_parts(asked.where("NOT _cut").select(*cells_of), rows, k, block_rows)
    # A list names an id, which stands for all its rows, as in the join above.
    shared = rows.groupBy("_cid").agg(F.count(F.lit(1)).cast("int").alias("_rows")).where("_rows > 1")
    copies = F.explode(F.array_repeat(F.lit(0), F.coalesce("_rows", F.lit(1))))
    whole = whole.join(shared, "_cid", "left").select("_qid", "_cid", "similarity", copies.alias("_copy")).drop("_copy")
    return _ranked(ranked.unionByName(whole), k, query_id, corpus_id)


def knn_by_label(
    queries: DataFrame,
    corpus: DataFrame,
    label: str,
    k: int = 3,
    query_id: str = "query_id",
    corpus_id: str = "corpus_id",
    vector: str = "embedding",
) -> DataFrame:
    """Search within the query's label; a query whose label the corpus lacks sees the whole corpus."""
    names = dict(k=k, query_id=query_id, corpus_id=corpus_id, vector=vector)
    labels = corpus.where(F.col(vector).isNotNull()).select(label).distinct()
    unknown = queries.join(labels, label, "left_anti")
    return knn(queries, corpus, partition=label, **names).unionByName(knn(unknown, corpus, **names))


def with_fallback(
    hits: DataFrame,
    queries: DataFrame,
    defaults: Sequence[Mapping],
    query_id: str = "query_id",
    k: int = 3,
) -> DataFrame:
    """Retrieved examples, plus the default examples for queries that have none.

    ``hits`` carries (query_id, similarity, customer_msg, brand_reply, thread_id,
    rank); the defaults are a literal array, exploded only for the misses.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(float(d["similarity"])).alias("similarity"),
                F.lit(d["customer_msg"]).alias("customer_msg"),
                F.lit(d["brand_reply"]).alias("brand_reply"),
                F.lit(d["thread_id"]).alias("thread_id"),
                F.lit(i).alias("rank"),
            )
            for i, d in enumerate(defaults[:k], 1)
        ]
    )
    missed = queries.join(hits.select(query_id).distinct(), query_id, "left_anti")
    filled = missed.select(query_id, F.inline(rows))
    return hits.select(*filled.columns).unionByName(filled)


def format_context(
    hits: DataFrame,
    brand: str,
    query_id: str = "query_id",
    queries: DataFrame | None = None,
    context: str = "retrieved_context",
) -> DataFrame:
    """One numbered context block per query, k examples each; a fixed text for queries without any."""
    block = F.format_string(
        '[Example %d] (Similarity: %.2f)\nCustomer: "%s"\n' + brand.replace("%", "%%") + ' Verified Resolution: "%s"',
        F.col("rank").cast("int"), "similarity", "customer_msg", "brand_reply",
    )
    ranked = hits.select(query_id, F.struct("rank", block.alias("block")).alias("_b"))
    texts = ranked.groupBy(query_id).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda b: b["block"]), "\n\n").alias(context)
    )
    if queries is None:
        return texts
    return (
        queries.select(query_id)
        .join(texts, query_id, "left")
        .withColumn(context, F.coalesce(context, F.lit(NO_CONTEXT)))
    )
