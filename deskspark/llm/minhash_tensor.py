"""Near-duplicates by MinHash with tensored banding.

Instead of m * m * 2r minhashes for m * m tables of 2r rows each, two
collections of m sub-keys of r minhashes are made (2 * m * r hashes) and a
table key is a pair of one sub-key from each. Texts that share a key are
candidates; all candidates of a cell are compared on their full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm import ngrams
from deskspark.llm.components import connected_components
from deskspark.llm.spread import attach, maybe_among, merged
from deskspark.sources.scratch import freeze


@dataclass(frozen=True)
class NearRule:
    """``words`` per shingle, the similarity in percent, minhashes per sub-key, the chance at most that a
    link right at the similarity shares no table, and the members compared at a time."""

    words: int = 5
    percent: int = 80
    rows: int = 2
    miss: float = 1e-4
    block: int = 1024

    @property
    def sub_keys(self) -> int:
        """m: both collections must agree in one of m sub-keys."""
        agree = (self.percent / 100) ** self.rows
        return math.ceil(math.log(self.miss / 2) / math.log(1 - agree))

    def linked(self, shared, a, b):
        """100 * intersection >= percent * union, for counts."""
        return 100 * shared >= self.percent * (a + b - shared)


def _signatures(rule: NearRule):
    """Task code: (doc_id, text) in, (doc_id, n_shingles, set_id, sub) out."""
    m, r = rule.sub_keys, rule.rows
    numbers = ngrams.mixed(np.arange(1, 4 * m * r + 1, dtype=np.uint64) * ngrams.M1)
    masks, factors = numbers[: 2 * m * r], numbers[2 * m * r :] | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, subs = [], [], []
            for _, texts in ngrams.chunks(batch.column(1)):
                sets = ngrams.shingles(texts, rule.words)
                counts = np.array([len(s) for s in sets])
                full = np.flatnonzero(counts)
                packed = np.zeros((len(sets), 2 * m), np.uint64)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    heads = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
                    for j in range(2 * m):
                        key = np.full(len(full), np.uint64(j))
                        for i in range(j * r, j * r + r):
                            least = np.minimum.reduceat((every ^ masks[i]) * factors[i], heads)
                            key = ngrams.mixed(key * ngrams.M1 + least)
                        packed[full, j] = key
                sizes.append(counts)
                names += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                subs += [row.tobytes() for row in packed]
            columns = [
                batch.column(0),
                pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                pa.array(names, pa.binary()),
                pa.array(subs, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "sub"])

    return run


def _sets(rule: NearRule):
    """Task code: cells of (.., text) in, the same with ``members``, packed shingle hashes, for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, texts in ngrams.chunks(batch.column(batch.num_columns - 1)):
                out += [s.tobytes() for s in ngrams.shingles(texts, rule.words)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "members"]
            )

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a bounded number of sets."""
    sizes = [len(s) for s in sets]
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, found = np.unique(every, return_inverse=True, return_counts=True)
    shared = found[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096  # columns at a time
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, (column[-1] + 1) if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sets), min(width, column[-1] + 1 - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _forest(rule: NearRule, nodes, own, side, sets) -> list[tuple[int, int]]:
    """Links that connect all linked members of a cell block, at most one less than members."""
    sizes = np.array([len(s) for s in sets])
    both = rule.linked(_overlaps(sets), sizes[:, None], sizes[None, :])
    both &= own[:, None] | own[None, :]
    if side.any() and not side.all():
        both &= side[:, None] != side[None, :]
    np.fill_diagonal(both, False)
    links, left = [], np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        wave = [root]
        while wave:
            at = wave.pop()
            new = np.flatnonzero(both[at] & left)
            left[new] = False
            links += [(int(nodes[at]), int(nodes[x])) for x in new]
            wave += new.tolist()
    return links


def _compare(rule: NearRule):
    """Task code: members sorted by cell block in, verified links out; one block is held at a time."""

    def links(held: list) -> pa.RecordBatch:
        nodes, own, side, sets = (list(x) for x in zip(*held))
        found = _forest(rule, np.array(nodes), np.array(own), np.array(side), sets) if len(held) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["node", "other"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for key, node, own, side, members in zip(
                zip(c["component"], c["cell"], c["i"], c["j"]), c["node"], c["own"], c["side"], c["members"]
            ):
                if key != at:
                    if len(held) > 1:
                        yield links(held)
                    at, held = key, []
                held.append((node, own, side, np.frombuffer(members, np.uint64)))
        if len(held) > 1:
            yield links(held)

    return run


def _candidate_groups(sets: DataFrame, rule: NearRule) -> DataFrame:
    """``node, component``: representatives joined through shared table keys."""
    m = rule.sub_keys
    sub = "hex(substring(sub, 8 * {} + 1, 8))"
    first = f"transform(sequence(0, {m - 1}), i -> {sub.format('i')})"
    second = f"transform(sequence({m}, {2 * m - 1}), i -> {sub.format('i')})"
    pairs = f"flatten(transform({first}, (a, i) -> transform({second}, (b, j) -> xxhash64(i, j, a, b))))"
    keys = sets.select("node", F.explode(F.expr(pairs)).alias("key"))
    shared = freeze(
        keys.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    met = attach(maybe_among(keys, "key", shared.select("key")), shared, "key", "n", "node", "inner", merge=True)
    return freeze(connected_components(met.where("node <> head").select("node", "head").distinct()))


def _verified(docs: DataFrame, sets: DataFrame, groups: DataFrame, rule: NearRule) -> DataFrame:
    """Links on full sets within the candidate groups.

    Linked sets differ in size by the similarity at most, so a group is cut into
    cells of similar size; a member also visits the next smaller cell. Cells
    over ``block`` members are cut further and their pieces met pairwise.
    """
    ratio = math.log(100 / rule.percent)
    members = groups.join(merged(sets.select("node", "n_shingles")), "node").withColumn(
        "cell", F.floor(F.log(F.col("n_shingles").cast("double")) / ratio + 1e-9).cast("int")
    )
    places = F.array(
        F.struct(F.col("cell").alias("cell"), F.lit(True).alias("own")),
        F.struct((F.col("cell") - 1).alias("cell"), F.lit(False).alias("own")),
    )
    placed = members.select("node", "component", F.explode(places).alias("p")).select("node", "component", "p.*")
    cells = freeze(
        placed.groupBy("component", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("owners"))
        .where("n > 1 AND owners > 0")
        .select(
            F.col("component").alias("_component"),
            F.col("cell").alias("_cell"),
            F.ceil(F.col("n") / rule.block).cast("int").alias("pieces"),
        )
    )
    piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    # The cell keys of one group are few (sizes on a log scale) but its members may be many: the group
    # is met by (component, cell) after it was spread over its pieces.
    met = placed.join(
        merged(cells), (F.col("component") == F.col("_component")) & (F.col("cell") == F.col("_cell"))
    ).withColumn("piece", piece)
    dealt = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "node",
        "component",
        "cell",
        "own",
        F.least("piece", "with").alias("i"),
        F.greatest("piece", "with").alias("j"),
        (F.col("piece") > F.col("with")).alias("side"),
    )
    dealt = freeze(dealt)
    wanted = dealt.select("node").distinct()
    texts = maybe_among(docs.select(F.col("doc_id").alias("node"), "text"), "node", wanted)
    key = ["component", "cell", "i", "j"]
    rows = dealt.join(merged(texts), "node").mapInArrow(
        _sets(rule), "node bigint, component bigint, cell int, own boolean, i int, j int, side boolean, members binary"
    )
    return (
        rows.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(_compare(rule), "node bigint, other bigint")
    )


def near_duplicates(
    docs: DataFrame, rule: NearRule = NearRule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    A-Z is lower-cased and words are runs of non-blank bytes; a text of fewer
    words than a shingle is one shingle. Texts without words (null, empty) have
    no set and are linked with nothing. Equal sets are one representative, their
    least doc_id, so that copies are never paired. Rows that share a doc_id are
    one document. An empty table gives an empty result; other columns are not
    looked at.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = freeze(
        base.mapInArrow(_signatures(rule), "doc_id bigint, n_shingles bigint, set_id binary, sub binary")
    )
    sets = freeze(
        signed.where("n_shingles > 0")
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("node"),
            F.count(F.lit(1)).alias("n"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sub").alias("sub"),
        )
    )
    groups = _candidate_groups(sets, rule)
    links = freeze(_verified(base, sets, groups, rule))
    joined = connected_components(links)
    names = freeze(
        sets.select("set_id", "node", "n")
        .join(merged(joined), "node", "left")
        .withColumn("component_id", F.coalesce("component", "node"))
        .where("n > 1 OR component_id <> node")
        .select("set_id", "component_id", "n")
    )
    component = F.coalesce("component_id", "doc_id")
    return attach(signed.drop("sub"), names, "set_id", "n", "doc_id", merge=True).select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def one_of_each(
    docs: DataFrame, rule: NearRule = NearRule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents without those that are near-duplicates of one with a smaller doc_id, with all columns."""
    gone = freeze(near_duplicates(docs, rule, id_col, text_col).where("NOT kept").select("doc_id"))
    return docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")
