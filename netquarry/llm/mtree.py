"""Exact top-k by inner product over a paged M-tree.

A vector x becomes the point (x, sqrt(M - |x|^2)), M the largest |x|^2, and a query q the point (q, 0): their squared distance
is |q|^2 + M - 2 q.x, so the nearest points have the highest inner products, and distances obey the triangle inequality.

The tree has pivots below its root, pages below each pivot and nodes in each page. Each routing object comes with a covering
radius and the distance to its parent, and each entry with the distance to its node. Every query first searches the page that
holds it; what it finds bounds its search. A block of queries (those of one page) then goes to the pages that its bounds
leave: pivots, pages and nodes whose stored distances already rule them out cost no distance, the nodes left over come in the
order of their least distance, and a query drops out at the first node beyond its bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import numbered_within, stored

#: Pivots at most (a sample by hash, which the index is fitted on), bytes and rows of a page at most, nodes of a page at most.
PIVOTS, PAGE_BYTES, PAGE_ROWS, NODES = 256, 1 << 19, 2048, 32
#: Pages whose rows come to one task together, and pages whose queries come to them together.
PAGES_IN_CELL, BLOCKS_IN_CELL = 8, 256
#: Squared norms stay below this, so that inner products and squared distances are exact in doubles.
LARGEST = 1 << 50

Hit = tuple[int, int, int]  # score, minus id, minus row: the larger, the better


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of every component; null for vectors that are null or hold a null or a component that isn't finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda x: F.floor(x.cast("double") * by)))


class Space:
    """What all tasks know: the number of components, M, the pivots, the rows at which each pivot's begin, and their radius."""

    def __init__(self, dims: int, most: int, pivots: list[list[int]]):
        self.dims, self.most = dims, most
        self.pivots = np.array([p + [0] * (dims - len(p)) for p in pivots], np.float64).reshape(len(pivots), dims)
        self.starts = self.ends = self.radius = np.zeros(0)
        self.slack = 1e-9 * (1 + most**0.5)  # more than what rounding can do to a distance
        self.page_rows = max(64, min(PAGE_ROWS, PAGE_BYTES // (4 * max(1, dims))))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.most - (x * x).sum(axis=1)))

    def apart(self, x: np.ndarray, y: np.ndarray, queries: bool = False) -> np.ndarray:
        """Distances of all x to all y; queries: x are queries, which aren't lifted."""
        inner = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
        up = self.lift(y)[None, :] - (0 if queries else self.lift(x)[:, None])
        return np.sqrt(np.maximum(0, inner + up * up))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer lists as rows, filled up with zeros."""
    lists = [np.array(x, np.int64) for x in column.to_pylist()]
    found = np.zeros((len(lists), dims), np.int32)
    for row, x in zip(found, lists):
        row[:len(x)] = x
    return found


def routers(space: Space, x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a page: the rows that are routing objects, the node of each row, and its distance to the node.

    Each next one is the row that is farthest from all before; there are no more if none is away from them.
    """
    chosen, near = [0], space.apart(x, x[:1])[:, 0]
    node = np.zeros(len(x), np.int32)
    while len(chosen) < limit and near.max() > space.slack:
        far = int(near.argmax())
        away = space.apart(x, x[far:far + 1])[:, 0]
        node[away < near] = len(chosen)
        near = np.minimum(near, away)
        chosen.append(far)
    return np.array(chosen), node, near


class Page:
    """A page of the tree as it is stored: entries by node, with their distances to it."""

    SCHEMA = "pivot int, first long, ids binary, rows binary, vectors binary, sizes binary, routers binary, radius binary, parent binary, entry binary, nearest double, farthest double"

    def __init__(self, space: Space, row: dict):
        self.pivot, self.first, self.nearest, self.farthest = row["pivot"], row["first"], row["nearest"], row["farthest"]
        self.ids, self.rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows"))
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(-1, space.dims).astype(np.float64)
        self.ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
        self.routers = self.vectors[np.frombuffer(row["routers"], np.int32)]
        self.radius, self.parent, self.entry = (np.frombuffer(row[c], np.float64) for c in ("radius", "parent", "entry"))

    @staticmethod
    def build(space: Space, pivot: int, first: int, ids: np.ndarray, rows: np.ndarray, far: np.ndarray, x: np.ndarray) -> dict:
        """far: the rows' distances to the pivot."""
        chosen, node, entry = routers(space, x.astype(np.float64), max(1, min(NODES, len(x) // 4)))
        order = np.argsort(node, kind="stable")
        sizes = np.bincount(node, minlength=len(chosen)).astype(np.int32)
        radius = np.array([entry[node == k].max(initial=0) for k in range(len(chosen))])
        at = np.empty(len(x), np.int32)
        at[order] = np.arange(len(x), dtype=np.int32)
        return {
            "pivot": pivot, "first": first, "ids": ids[order].tobytes(), "rows": rows[order].tobytes(), "vectors": x[order].tobytes(), "sizes": sizes.tobytes(), "routers": at[chosen].tobytes(),
            "radius": radius.tobytes(), "parent": far[chosen].tobytes(), "entry": entry[order].tobytes(), "nearest": float(far.min()), "farthest": float(far.max()),
        }


class Queries:
    """A block of queries and the best that each has found so far."""

    def __init__(self, space: Space, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, k: int, hits: list[list[Hit]] | None = None):
        self.space, self.ids, self.rows, self.x, self.k = space, ids, rows, x.astype(np.float64), k
        self.hits, self.found = hits or [[] for _ in ids], [False] * len(ids)
        self.to_pivots = space.apart(self.x, space.pivots, queries=True)
        self.norms = (self.x * self.x).sum(axis=1)
        self.worst, self.bound = np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
        for q in range(len(ids)):
            self.tighten(q)

    def tighten(self, q: int) -> None:
        if len(self.hits[q]) >= self.k:
            self.worst[q] = self.hits[q][0][0]
            self.bound[q] = np.sqrt(max(0.0, self.norms[q] + self.space.most - 2 * self.worst[q])) + self.space.slack

    def offer(self, active: np.ndarray, scores: np.ndarray, page: Page, at: np.ndarray) -> None:
        for q, c in zip(*np.nonzero(scores >= self.worst[active][:, None])):
            query, entry = int(active[q]), int(at[c])
            if page.rows[entry] == self.rows[query]:
                continue
            hit, best = (int(scores[q, c]), -int(page.ids[entry]), -int(page.rows[entry])), self.hits[query]
            if len(best) < self.k:
                heapq.heappush(best, hit)
            elif hit > best[0]:
                heapq.heapreplace(best, hit)
            else:
                continue
            self.found[query] = True
            self.tighten(query)

    def search(self, page: Page) -> None:
        to_pivot = self.to_pivots[:, page.pivot]
        near = np.nonzero(np.maximum(to_pivot - page.farthest, page.nearest - to_pivot) <= self.bound)[0]
        if not len(near):
            return
        # the stored distances rule nodes out for queries before any distance to a routing object is computed
        open_ = np.abs(to_pivot[near][:, None] - page.parent[None, :]) - page.radius[None, :] <= self.bound[near][:, None]
        nodes = np.nonzero(open_.any(axis=0))[0]
        if not len(nodes):
            return
        away = np.full((len(self.ids), len(page.radius)), np.inf)
        away[np.ix_(near, nodes)] = np.where(open_[:, nodes], self.space.apart(self.x[near], page.routers[nodes], queries=True), np.inf)
        least = away - page.radius[None, :]
        queue = [(float(least[:, n].min()), int(n)) for n in nodes]
        heapq.heapify(queue)
        while queue:
            at_least, n = heapq.heappop(queue)
            if at_least > self.bound.max():
                return
            active = np.nonzero(least[:, n] <= self.bound)[0]
            if not len(active):
                continue
            entries = np.arange(page.ends[n - 1] if n else 0, page.ends[n])
            apart = np.abs(away[active, n][:, None] - page.entry[entries][None, :])
            entries = entries[(apart <= self.bound[active][:, None]).any(axis=0)]
            if len(entries):
                self.offer(active, self.x[active] @ page.vectors[entries].T, page, entries)

    def ranges(self) -> list[tuple[int, int]]:
        """The rows of the pivots that a bound leaves to any query."""
        left = (self.to_pivots - self.space.radius[None, :] <= self.bound[:, None]).any(axis=0)
        return [(int(self.space.starts[p]), int(self.space.ends[p])) for p in np.nonzero(left)[0]]


_HITS = "array<struct<score:long,id:long,row:long>>"
_BLOCK = f"first long, ids binary, rows binary, vectors binary, hits array<{_HITS}>, cells array<long>"
_FOUND = f"query_id long, query_row long, hits {_HITS}"
_HIT_TYPE = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())]))


def _listed(hits: list[Hit]) -> list[dict]:
    return [{"score": s, "id": -i, "row": -r} for s, i, r in hits]


def _heaps(hits: list[list[dict]]) -> list[list[Hit]]:
    found = [[(h["score"], -h["id"], -h["row"]) for h in x] for x in hits]
    for x in found:
        heapq.heapify(x)
    return found


def _pages(space: Space, placed: DataFrame) -> DataFrame:
    """One row for each page: a pivot's rows in the order of their distance to it, page_rows at a time."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place").combine_chunks()
        pivot, first = rows["pivot"][0].as_py(), rows["_first"][0].as_py() + rows["_place"][0].as_py()
        x = np.frombuffer(b"".join(rows["v"].to_pylist()), np.int32).reshape(-1, space.dims)
        ids, far = rows["id"].to_numpy(), rows["far"].to_numpy()
        page = Page.build(space, pivot, first, ids, first + np.arange(len(ids)), far, x)
        asked = np.array([i for i, q in enumerate(rows["asked"].to_pylist()) if q], np.int64)
        page |= {"q_ids": ids[asked].tobytes(), "q_rows": (first + asked).tobytes(), "q_vectors": x[asked].tobytes()}
        return pa.table({c: [v] for c, v in page.items()}).cast(schema)

    fields = [*Page.SCHEMA.split(", "), "q_ids binary", "q_rows binary", "q_vectors binary"]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in fields)])
    return placed.groupBy("pivot", F.floor(F.col("_place") / space.page_rows)).applyInArrow(build, ", ".join(fields))


def _own_pages(space: Space, k: int):
    """Queries search the page they are in; gives blocks with what they found, and the cells that it leaves to search."""
    cell_rows = PAGES_IN_CELL * space.page_rows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["q_ids"]:
                    continue
                ids, rows = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "q_rows"))
                block = Queries(space, ids, rows, np.frombuffer(row["q_vectors"], np.int32).reshape(-1, space.dims), k)
                block.search(Page(space, row))
                cells = sorted({c for a, b in block.ranges() for c in range(a // cell_rows, (b - 1) // cell_rows + 1)})
                yield pa.RecordBatch.from_pylist([{
                    "first": row["first"], "ids": row["q_ids"], "rows": row["q_rows"], "vectors": row["q_vectors"], "hits": [_listed(h) for h in block.hits], "cells": cells,
                }], schema=pa.schema([("first", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("vectors", pa.binary()), ("hits", pa.list_(_HIT_TYPE)), ("cells", pa.list_(pa.int64()))]))

    return search


def _other_pages(space: Space, k: int):
    """The pages of a cell with the blocks of queries that come to it; gives what queries found there beyond their own page."""
    names = [f.split()[0] for f in Page.SCHEMA.split(", ")]

    def search(pages: pa.Table, blocks: pa.Table) -> pa.Table:
        found: list[dict] = []
        if pages.num_rows and blocks.num_rows:
            tree = [Page(space, row) for row in pages.select(names).to_pylist()]
            for row in blocks.to_pylist():
                ids, rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows"))
                block = Queries(space, ids, rows, np.frombuffer(row["vectors"], np.int32).reshape(-1, space.dims), k, _heaps(row["hits"]))
                order = sorted(((max(0.0, float(np.maximum(block.to_pivots[:, p.pivot] - p.farthest, p.nearest - block.to_pivots[:, p.pivot]).min())), p.first, p) for p in tree if p.first != row["first"]), key=lambda x: x[:2])
                for _, _, page in order:
                    block.search(page)
                found += [{"query_id": int(ids[q]), "query_row": int(rows[q]), "hits": _listed(block.hits[q])} for q in range(len(ids)) if block.found[q]]
        return pa.Table.from_pylist(found, schema=pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("hits", _HIT_TYPE)]))

    return search


def top_k(df: DataFrame, id_col: str, vector_col: str, asked: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): for each row where asked is true the k other rows of highest inner product, ties to the smaller id.

    vector_col holds integers (see scaled()); shorter vectors count as filled up with zeros, an empty one is all zeros. Rows
    whose vector or id is null take no part. Repeated rows are rows of their own: each is a query, if asked, and found by all
    others. Squared norms from LARGEST on raise ValueError, as they would no longer be exact. Queries with no other row, and
    an empty table, give no rows. The search is exact, whatever the pivots are; a group of equal vectors of any size is pages
    like any other.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    norm = F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x)
    n, most, dims = rows.select(norm.alias("norm"), F.size("v").alias("d")).agg(F.count(F.lit(1)), F.max("norm"), F.max("d")).first()
    if (most or 0) >= LARGEST:
        raise ValueError(f"squared norms have to be below {LARGEST}")
    # PIVOTS rows of one vector each, at most
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(max(1, min(PIVOTS, (n or 0) // PAGE_ROWS))).select("v").collect()
    space = Space(max(1, dims or 1), int(most or 0), [list(r.v) for r in sample] or [[]])

    def near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part["v"], space.dims)
                away = space.apart(x.astype(np.float64), space.pivots)
                pivot = away.argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array([r.tobytes() for r in x], pa.binary()), part["asked"], pa.array(pivot), pa.array(away[np.arange(len(x)), pivot])], names=["id", "v", "asked", "pivot", "far"])

    dealt = rows.mapInArrow(near_pivot, "id long, v binary, asked boolean, pivot int, far double")
    placed = stored(numbered_within(dealt, "pivot", "far", "id", "v"))
    # at most PIVOTS rows
    spans = {r.pivot: r for r in placed.groupBy("pivot").agg(F.min("_first").alias("start"), F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    space.starts = np.array([spans[p].start if p in spans else 0 for p in range(len(space.pivots))])
    space.ends = np.array([spans[p].start + spans[p].n if p in spans else 0 for p in range(len(space.pivots))])
    space.radius = np.array([spans[p].radius if p in spans else -np.inf for p in range(len(space.pivots))])
    pages = stored(_pages(space, placed))
    blocks = stored(pages.mapInArrow(_own_pages(space, k), _BLOCK))
    cell_rows, stripe_rows = PAGES_IN_CELL * space.page_rows, BLOCKS_IN_CELL * space.page_rows
    stripes = blocks.select(F.floor(F.col("first") / stripe_rows).alias("stripe"), "*")
    there = F.sequence(F.lit(0), F.lit(max(0, (n or 0) - 1) // stripe_rows)).cast("array<long>")
    left = pages.drop("q_ids", "q_rows", "q_vectors").select(F.floor(F.col("first") / cell_rows).alias("cell"), F.explode(there).alias("stripe"), "*")
    right = stripes.select(F.explode("cells").alias("cell"), *[c for c in stripes.columns if c != "cells"])
    further = left.groupBy("cell", "stripe").cogroup(right.groupBy("cell", "stripe")).applyInArrow(_other_pages(space, k), _FOUND)
    own = blocks.mapInArrow(_own_hits, _FOUND)
    hits = own.unionByName(further).select("query_id", "query_row", F.explode("hits").alias("h")).select("query_id", "query_row", "h.*").distinct()
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _own_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows), pa.array(row["hits"], _HIT_TYPE)], names=["query_id", "query_row", "hits"])
