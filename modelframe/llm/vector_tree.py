"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

The tree's top is fitted on a bounded sample. Leaves that hold too many of the table's rows are then split by trees of
their own, each fitted in Spark on a bounded sample of the leaf's rows, until none does or there are MOST leaves; so
leaves keep their size as the table grows, and what a query visits doesn't. The tree, some MB and at most MOST leaves, is
sent out with the code; every vector is indexed under its leaf. A query walks the tree through a priority queue of nodes, nearest centre first, and
visits leaves in the order they come up. How many it visits is calibrated: on sample queries the true neighbours are
found by brute force over all vectors, and visits widen until the asked recall is reached.

Equal vectors are searched once: of each distinct vector only its first k + 1 ids can be among any k neighbours, with
ties to the smaller id, so a vector that a third of all rows share costs what any other does. Visits meet leaves in a
join; large leaves are split into parts, each returns its k best of a query, and these are merged.

Edge cases: rows with a null vector, a null or non-finite component, no length, another number of components than
most rows have, or a null id take no part; fewer candidates than k give all there are; ties go to the smaller id;
repeated rows are candidates each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelframe.llm.common import Stored, map_in_arrow

#: Vectors the tree's top is fitted on at most and the bytes they may take, children of a node, sample vectors a leaf has at most.
SAMPLE, BYTES, BRANCH, LEAF = 20_000, 64 << 20, 8, 256
#: Rows that a leaf should hold at most, rows a leaf's own tree is fitted on, leaves that the whole tree has at most.
ROWS, FITTED, MOST = 4096, 20_000, 200_000
#: Sample queries for calibration, recall asked of them.
TRIALS, RECALL = 200, 0.95
#: Vectors of a part of a leaf, queries of a part of its visitors.
PART, VISITORS = 4096, 8192
#: Scores by matrix product may differ from exact ones by so much of themselves.
SLACK = 1e-9
_SEED = 7


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        d = (centres**2).sum(axis=1) - 2 * x @ centres.T
        new = d.argmin(axis=1)
        if (new == own).all() and _:
            break
        own = new
        for j in range(k):
            if (own == j).any():
                centres[j] = x[own == j].mean(axis=0)
    return centres, own


class Tree:
    """Nodes in arrays: centre, children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF):
        rng = np.random.Generator(np.random.PCG64(_SEED))
        self.centre: list[np.ndarray] = [sample.mean(axis=0)] if len(sample) else [np.zeros(sample.shape[1])]
        self.kids: list[list[int]] = [[]]
        todo = [(0, np.unique(sample, axis=0))]
        while todo:
            node, x = todo.pop()
            if len(x) <= leaf:
                continue
            centres, own = _kmeans(x, branch, rng)
            used = np.unique(own)
            if len(used) < 2:
                continue
            for j in used:
                self.kids[node].append(len(self.centre))
                todo.append((len(self.centre), x[own == j]))
                self.centre.append(centres[j])
                self.kids.append([])
        self._numbered()

    def _numbered(self) -> None:
        self.centre_of = np.array(self.centre)
        self.leaf_no = {n: i for i, n in enumerate(n for n, k in enumerate(self.kids) if not k)}

    def graft(self, grown: dict[int, tuple[list[list[int]], np.ndarray]]) -> None:
        """Puts trees (children, centres; node 0 is the leaf itself) in the place of numbered leaves."""
        node_of = {i: n for n, i in self.leaf_no.items()}
        for leaf, (kids, centres) in sorted(grown.items()):
            # nodes but the first move behind those that are there
            moved = [node_of[leaf], *range(len(self.centre), len(self.centre) + len(kids) - 1)]
            for k, own in enumerate(kids):
                if k:
                    self.centre.append(centres[k])
                    self.kids.append([])
                self.kids[moved[k]] = [moved[j] for j in own]
        self._numbered()

    def leaves(self) -> int:
        return len(self.leaf_no)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child's, from the top down."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            kids = self.kids[node]
            if not kids:
                out[rows] = self.leaf_no[node]
                continue
            c = self.centre_of[kids]
            near = ((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(kid, rows[near == j]) for j, kid in enumerate(kids)]
        return out

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first `most` leaves that best-bin-first search comes to; more until they hold `need` vectors."""
        queue, order, found = [(0.0, 0)], [], 0
        while queue and (len(order) < most or found < need):
            _, node = heapq.heappop(queue)
            kids = self.kids[node]
            if not kids:
                order.append(self.leaf_no[node])
                found += int(held[order[-1]]) if held is not None else 0
                continue
            for kid, score in zip(kids, self.centre_of[kids] @ q):
                heapq.heappush(queue, (-float(score), kid))
        return order


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def taking_part(embeddings: DataFrame) -> DataFrame:
    """Stored rows (vec_id, v) that take part; v as given if its components are float, else double."""
    single = embeddings.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    v = F.col("embedding").cast(f"array<{'float' if single else 'double'}>")
    rows = embeddings.select(F.col("vec_id").cast("long"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    held = Stored(rows).df
    usual = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return held.where(F.size("v") == usual["n"]) if usual else held


def _top(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of each key: larger score, then smaller id."""
    order = np.lexsort((ids, -scores, keys))
    first = np.concatenate([[0], np.flatnonzero(np.diff(keys[order])) + 1]) if len(order) else np.empty(0, int)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < k]


def _refined(tree: Tree, distinct: DataFrame, rows_a_leaf: int = ROWS, fitted: int = FITTED, most: int = MOST) -> Tree:
    """The tree with leaves split until they hold about so many rows of the table (v)."""
    kind = distinct.schema["v"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(tree.assign(_vectors(batch.column("v"))))], ["v", "leaf"])

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        x = _vectors(rows.column("v").combine_chunks())
        # as many rows of the sample to a leaf as stand for rows_a_leaf of the table
        own = Tree(x, leaf=max(4, int(len(x) * rows_a_leaf / rows.column("n")[0].as_py())))
        return pa.table(
            {
                "leaf": pa.array([key[0].as_py()] * len(own.kids), pa.int32()),
                "node": pa.array(range(len(own.kids)), pa.int32()),
                "kids": pa.array(own.kids, pa.list_(pa.int32())),
                "centre": pa.array(own.centre_of.tolist(), pa.list_(pa.float64())),
            }
        )

    fitted = min(fitted, BYTES // (8 * tree.centre_of.shape[1]))
    while tree.leaves() < most:
        index = map_in_arrow(distinct.select("v"), placed, f"v {kind}, leaf int")
        held = index.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * rows_a_leaf)
        large = sorted(((r["n"], r["leaf"]) for r in held.collect()), reverse=True)[: max(1, most - tree.leaves())]
        if not large:
            break
        counts = distinct.sparkSession.createDataFrame([(leaf, n) for n, leaf in large], "leaf int, n long")
        whole = 1 << 30
        dealt = F.pmod(F.xxhash64("v", F.lit(tree.leaves())), F.lit(whole))
        some = index.join(F.broadcast(counts), "leaf").where(dealt < F.lit(float(fitted * whole)) / F.col("n"))
        grown: dict[int, dict[int, tuple[list[int], list[float]]]] = {}
        for r in some.groupBy("leaf").applyInArrow(fit, "leaf int, node int, kids array<int>, centre array<double>").collect():
            grown.setdefault(r["leaf"], {})[r["node"]] = (r["kids"], r["centre"])
        before = tree.leaves()
        tree.graft({leaf: ([own[k][0] for k in sorted(own)], np.array([own[k][1] for k in sorted(own)])) for leaf, own in grown.items()})
        if tree.leaves() == before:  # what is left are vectors too alike to part
            break
    return tree


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL, rows_a_leaf: int = ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for rows with vec_id divisible by `every`, the k largest inner products."""
    rows = taking_part(embeddings)
    kind = rows.schema["v"].dataType.simpleString()
    schema = "query_id long, rank int, vec_id long, score double"
    # of equal vectors the first k + 1 ids can matter to a query; all queries keep their ids
    distinct = Stored(_first_ids(rows, k + 1)).df
    first = distinct.select(F.size("v").alias("n")).first()
    taken = min(SAMPLE, BYTES // (8 * first["n"])) if first else 0
    sample = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("v"), "v").select("v").limit(taken).collect()], np.float64)
    if not len(sample):
        return embeddings.sparkSession.createDataFrame([], schema)
    tree = _refined(Tree(sample), distinct, rows_a_leaf)
    leaf_of = tree.assign(sample)
    held_by = np.bincount(leaf_of, minlength=tree.leaves())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaf = tree.assign(_vectors(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["v", "ids", "leaf"])

    index = Stored(
        map_in_arrow(distinct.select("v", "ids"), placed, f"v {kind}, ids array<long>, leaf int")
        .withColumn("uid", F.monotonically_increasing_id())
    ).df
    parts_of = index.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(PART)).alias("parts"))
    most = _calibrated(index, tree, sample, k, recall)
    asking = rows.where(F.col("vec_id") % every == 0).select("v", F.col("vec_id").alias("query_id"))
    queries = asking.select("v").distinct()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            asked_ = _vectors(batch.column("v"))
            found = [tree.visits(q, most, held_by, k + 1) for q in asked_]
            # what a neighbour scores at least: the visited leaves hold k + 1 of the sample as good, perhaps the query too
            floor = np.full(len(asked_), -np.inf)
            for i, (q, leaves) in enumerate(zip(asked_, found)):
                scores = (sample @ q)[np.isin(leaf_of, leaves)]
                if len(scores) > k:
                    floor[i] = np.partition(scores, -k - 1)[-k - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), pa.array(floor - SLACK * np.abs(floor).clip(1)), pa.array(found, pa.list_(pa.int32()))],
                ["query", "floor", "leaves"],
            )

    asked = Stored(queries.withColumn("query", F.monotonically_increasing_id())).df
    visits = Stored(
        map_in_arrow(asked.select("query", "v"), walk, "query long, floor double, leaves array<int>")
        .select("query", "floor", F.explode("leaves").alias("leaf"))
    ).df
    turns_of = visits.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(VISITORS)).alias("turns"))
    # a part of a leaf and a part of its visitors meet in one task; every vector is there for every visitor
    shape = Stored(parts_of.join(turns_of, "leaf")).df
    until = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    met = (
        visits.join(shape, "leaf")
        .withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")))
        .select("query", "floor", "leaf", "turn", until("parts").alias("part"))
        .join(asked.select("query", F.col("v").alias("q")), "query")
    )
    held = (
        index.join(shape, "leaf")
        .withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
        .select("v", "ids", "leaf", "part", until("turns").alias("turn"))
    )

    def search(key: tuple, asking: pa.Table, there: pa.Table) -> pa.Table:
        if not len(asking) or not len(there):
            return pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, ids = _vectors(there.column("v").combine_chunks()), there.column("ids").to_pylist()
        out = []
        for at in range(0, len(asking), 256):
            part = asking.slice(at, 256)
            q = _vectors(part.column("q").combine_chunks())
            rough = q @ x.T
            least = part.column("floor").to_numpy()
            if len(x) > k:
                own = np.partition(rough, -k - 1, axis=1)[:, -k - 1]
                least = np.maximum(least, own - SLACK * np.abs(own).clip(1))
            # all that tie with the last one taken stay in
            who, what = np.nonzero(rough >= least[:, None])
            exact = products(q[who], x[what])
            sizes = np.fromiter((len(ids[j]) for j in what), np.int64, len(what))
            keys = np.repeat(who, sizes)
            flat = np.array([i for j in what for i in ids[j]], np.int64)
            value = np.repeat(exact, sizes)
            rows_ = _top(keys, flat, value, k + 1)
            out.append(pa.table({"query": part.column("query").combine_chunks().take(pa.array(keys[rows_])), "vec_id": flat[rows_], "score": value[rows_]}))
        return pa.concat_tables(out)

    partial = met.groupBy("leaf", "part", "turn").cogroup(held.groupBy("leaf", "part", "turn")).applyInArrow(
        search, "query long, vec_id long, score double"
    )

    def merge(rows_: pd.DataFrame) -> pd.DataFrame:
        best = _top(rows_["query"].to_numpy(), rows_["vec_id"].to_numpy(), rows_["score"].to_numpy(), k + 1)
        return rows_.iloc[best]

    best = (
        partial.withColumn("deal", F.pmod(F.xxhash64("query", F.lit(3)), F.lit(4096)))
        .groupBy("deal")
        .applyInPandas(lambda g: merge(g[["query", "vec_id", "score"]]), "query long, vec_id long, score double")
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    )
    # a query is no candidate of its own
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return (
        best.join(asking.join(asked, "v").select("query", "query_id"), "query")
        .select("query_id", F.posexplode(others).alias("at", "f"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))
    )


def _first_ids(rows: DataFrame, most: int) -> DataFrame:
    """Rows (v, ids): each distinct vector with its `most` smallest ids, first taken within parts of its rows."""
    few = lambda c: F.slice(F.array_sort(c), 1, most)
    return (
        rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
        .groupBy("v", "part")
        .agg(few(F.collect_list("vec_id")).alias("ids"))
        .groupBy("v")
        .agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    )


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner product of each row of q with that of x in double precision, summed in the order of components."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def _calibrated(index: DataFrame, tree: Tree, sample: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that sample queries find this share of their true neighbours among all distinct vectors."""
    rng = np.random.Generator(np.random.PCG64(_SEED + 1))
    trials = sample[rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            scores, leaf = trials @ _vectors(batch.column("v")).T, batch.column("leaf").to_numpy()
            both = (scores, np.broadcast_to(leaf, scores.shape))
            kept = both if kept is None else tuple(np.concatenate(p, axis=1) for p in zip(kept, both))
            take = np.argsort(-kept[0], axis=1, kind="stable")[:, : k + 1]
            kept = tuple(np.take_along_axis(a, take, axis=1) for a in kept)
        if kept is not None:
            who = np.repeat(np.arange(len(trials)), kept[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(kept[0].ravel()), pa.array(kept[1].ravel().astype(np.int32))], ["q", "s", "leaf"])

    # one partial top a task: tasks * trials * (k + 1) numbers at most, merged by query
    found = (
        map_in_arrow(index.select("v", "leaf"), best, "q long, s double, leaf int")
        .groupBy("q")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "leaf")), asc=False), 1, k + 1).alias("f"))
        .collect()
    )
    ranks = []
    for row in found:
        place = {leaf: i for i, leaf in enumerate(tree.visits(trials[row["q"]], tree.leaves()))}
        ranks += [place[f["leaf"]] + 1 for f in row["f"][1:]]  # the first is the query itself
    return max(1, int(np.quantile(ranks, recall, method="higher"))) if ranks else tree.leaves()
