"""Hard negatives by best-first search in an R-tree that is packed by sort-tile-recursive.

Vectors become whole numbers and are tiled: slabs of the coordinate that varies most, in each slab slabs of the next one,
in each tile pages of ``LEAF`` rows by its own coordinates. A page is a leaf: its rows and the least and greatest value of
each coordinate. Neighbouring leaves stand together in the leaf table, so tasks build the upper levels over what they
read. A box bounds the inner product with an anchor coordinate by coordinate; a queue takes the box with the highest
bound first and drops boxes whose interval misses an anchor's score window or ends strictly below its k-th score so far.

Anchors go to all leaves in blocks of bounded size; a block is first asked on a part of the leaves, whose k-th scores are
lower bounds for all others, so a task returns few rows that do not count. Inner products are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklogs.llm.common import forget, unused, written

LEAF = 128
FANOUT = 16
TILE_ROWS = 8192
MOST_SLABS = 64
#: Anchors that are sent to the leaves at once, and those that a task asks at once.
BLOCK, TOGETHER = 4096, 1024
#: Leaves of a task that are in memory at once.
CHUNK = 256
#: One leaf in so many gives the first bounds.
PILOT = 64
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_LEAVES = "dim int, n int, asked int, type string, low binary, high binary, vectors binary, id binary, label binary, is_asked binary"
_FOUND = "anchor long, anchor_id long, window int, positive_id long, positive_score long, id long, score long"


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(values) else np.zeros((len(column), 0))


def page_order(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Rows of ``x`` cut into pages by sort-tile-recursive: slabs of the coordinate that varies most, in each of these
    slabs of the next one, and pages of ``leaf`` rows at the end. Up to three coordinates are used."""
    axes = np.argsort(-x.var(axis=0), kind="stable")[:3].tolist() if len(x) else []

    def cut(rows: np.ndarray, axes: list[int]) -> Iterator[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if axes:
            rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
        if len(axes) < 2:
            yield from (rows[at : at + leaf] for at in range(0, len(rows), leaf))
            return
        slabs = int(np.ceil(pages ** (1 / len(axes))))
        size = -(-pages // slabs) * leaf
        for at in range(0, len(rows), size):
            yield from cut(rows[at : at + size], axes[1:])

    return list(cut(np.arange(len(x)), axes))


def _smallest(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _leaf_rows(tile: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    x, ids, labels, asked = (np.concatenate(c) for c in zip(*tile, strict=True))
    rows = []
    for page in page_order(x):
        own = _smallest(x[page])
        low, high = (own.min(axis=0), own.max(axis=0)) if own.shape[1] else (own[0], own[0])
        rows.append((x.shape[1], len(page), int(asked[page].sum()), own.dtype.str, *(a.tobytes() for a in (low, high, own, ids[page], labels[page], asked[page]))))
    kinds = [pa.int32()] * 3 + [pa.string()] + [pa.binary()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _LEAVES.split(", ")])


def packed_leaves(rows: DataFrame, asked: Column, scale: float) -> DataFrame:
    """The leaves over ``rows`` (vec_id, label, embedding), one a row; vectors are floor(scale * component).

    Tiles are cut at approximate quantiles. One that holds more than ``TILE_ROWS`` rows, as of a vector that very many
    share, is dealt into parts by chance, so no task gathers it.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), asked.alias("asked"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("embedding")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                x = _matrix(lists.filter(pa.array(size == dim)))
                total[dim] = total.get(dim, 0) + np.stack([np.full(dim, len(x)), x.sum(axis=0), (x**2).sum(axis=0)], axis=1)
        for dim, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), *(pa.array(sums[:, k].astype(float)) for k in range(3))], ["axis", "n", "total", "squares"])

    spread = rows.select("embedding").mapInArrow(moments, "axis long, n double, total double, squares double").groupBy("axis").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s"))
    axes = spread.orderBy(F.desc(F.col("s") / F.col("n") - (F.col("t") / F.col("n")) ** 2), "axis").limit(2).collect()
    slabs = min(MOST_SLABS, int(np.ceil(np.sqrt(max([r["n"] for r in axes], default=0) / TILE_ROWS))) or 1)
    at = [F.coalesce(F.try_element_at("embedding", F.lit(r["axis"] + 1)), F.lit(0.0)) for r in axes]
    cuts = F.array(*[F.lit(k / slabs) for k in range(1, slabs)])
    tile: Column = F.lit(0)
    if at and slabs > 1:
        # numbers by the slab at most, and by two slabs: MOST_SLABS squared
        first = rows.select(F.percentile_approx(at[0], cuts, 1000)).first()[0]
        over = lambda x, bounds: F.size(F.filter(bounds, lambda b: b < x))
        tile = over(at[0], F.array(*map(F.lit, first)))
        if len(at) > 1:
            second = {r["slab"]: r["cuts"] for r in rows.select(tile.alias("slab"), at[1].alias("x")).groupBy("slab").agg(F.percentile_approx("x", cuts, 1000).alias("cuts")).collect()}
            bounds = F.array(*[F.array(*[F.lit(float(b)) for b in second.get(k, [0.0] * (slabs - 1))]) for k in range(slabs)])
            tile = tile * MOST_SLABS + over(at[1], F.element_at(bounds, tile + 1))
    tiled = rows.withColumns({"tile": tile.cast("int"), "dim": F.size("embedding"), "row": F.monotonically_increasing_id()})
    parts = F.broadcast(tiled.groupBy("tile", "dim").agg(F.ceil(F.count("*") / TILE_ROWS).alias("parts")))  # MOST_SLABS squared rows for each length of vectors
    dealt = tiled.join(parts, ["tile", "dim"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("tile", "dim", "part")])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                if held and tuple(key[:, a]) != now:
                    yield from _leaf_rows(held)
                    held = []
                now, own = tuple(key[:, a]), batch.slice(a, b - a)
                numbers = np.floor(_matrix(own.column("embedding")) * scale)
                held.append((numbers, *(own.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("vec_id", np.int64), ("label", np.int64), ("asked", bool)))))
        if held:
            yield from _leaf_rows(held)

    order = ["tile", "dim", "part"]
    return dealt.repartition(*order).sortWithinPartitions(*order).select(*order, "vec_id", "label", "asked", "embedding").mapInArrow(run, _LEAVES)


class Tree:
    """An R-tree over some leaves of one dimension; ``levels[0]`` are the boxes of the leaves."""

    def __init__(self, leaves: list[dict]):
        read = lambda r, name, shape: np.frombuffer(r[name], r["type"]).astype(np.float64).reshape(shape)
        dim = leaves[0]["dim"]
        self.x = [read(r, "vectors", (r["n"], dim)) for r in leaves]
        self.ids = [np.frombuffer(r["id"], np.int64) for r in leaves]
        self.labels = [np.frombuffer(r["label"], np.int64) for r in leaves]
        boxes = np.array([[read(r, "low", dim), read(r, "high", dim)] for r in leaves]).reshape(len(leaves), 2, dim)
        self.levels = [boxes]
        while len(boxes) > 1:
            boxes = np.array([[boxes[k : k + FANOUT, 0].min(axis=0), boxes[k : k + FANOUT, 1].max(axis=0)] for k in range(0, len(boxes), FANOUT)])
            self.levels.append(boxes)
        self.most = float(np.abs(self.levels[-1]).max(initial=0))


class Asked:
    """Anchors of one dimension with their score windows, and the best rows that each window has found so far."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, k: int, same: bool):
        self.q, self.ids, self.labels, self.low, self.high, self.kth, self.k, self.same = q, ids, labels, low, high, kth.copy(), k, same
        self.up, self.down = np.maximum(q, 0), np.minimum(q, 0)
        self.most = float(np.abs(q).max(initial=0))
        self.held, self.fresh, self.waiting = [np.zeros(0, np.int64)] * 3, [], 0  # (anchor and window, score, id) of the best, and what came since
        self.visited = 0

    def search(self, tree: Tree) -> None:
        """Put in the rows of ``tree``, box by box from the highest bound down."""
        exact = self.most * tree.most * self.q.shape[1] < 2**52
        bounds = []
        for boxes in tree.levels:
            if exact:
                bounds.append((self.up @ boxes[:, 0].T + self.down @ boxes[:, 1].T, self.up @ boxes[:, 1].T + self.down @ boxes[:, 0].T))
            else:  # too large to bound in doubles: every box may hold any score
                bounds.append((np.full((len(self.q), len(boxes)), -np.inf), np.full((len(self.q), len(boxes)), np.inf)))
        ceiling = self.high.max(axis=1)

        def alive(level: int, box: int) -> np.ndarray:
            low, high = bounds[level][0][:, box, None], bounds[level][1][:, box, None]
            return ((low <= self.high) & (high >= np.maximum(self.low, self.kth)) & (self.low <= self.high)).any(axis=1)

        def offer(level: int, box: int) -> None:
            rows = alive(level, box)
            if rows.any():
                heapq.heappush(queue, (-float(np.minimum(bounds[level][1][rows, box], ceiling[rows]).max()), level, box))

        queue: list[tuple[float, int, int]] = []
        offer(len(tree.levels) - 1, 0)
        while queue:
            _, level, box = heapq.heappop(queue)
            if level:
                for child in range(box * FANOUT, min((box + 1) * FANOUT, len(tree.levels[level - 1]))):
                    offer(level - 1, child)
                continue
            rows = np.flatnonzero(alive(0, box))  # others may have found better rows since the box was offered
            if len(rows):
                self._put(rows, tree, box, exact)
        self._settle()

    def _put(self, rows: np.ndarray, tree: Tree, box: int, exact: bool) -> None:
        self.visited += 1
        if exact:
            score = (self.q[rows] @ tree.x[box].T).astype(np.int64)
        else:
            whole = [[[int(v) for v in r] for r in m] for m in (self.q[rows], tree.x[box])]
            score = np.array([[min(max(sum(a * b for a, b in zip(x, y, strict=True)), _LEAST + 1), _MOST) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(rows), -1)
        fits = self.labels[rows, None] == tree.labels[box][None]
        fits = fits & (self.ids[rows, None] != tree.ids[box][None]) if self.same else ~fits
        for w in range(self.low.shape[1]):
            hit = fits & (score >= np.maximum(self.low[rows, w], self.kth[rows, w])[:, None]) & (score <= self.high[rows, w, None])
            i, j = np.nonzero(hit)
            if len(i):
                self.fresh.append((rows[i] * self.low.shape[1] + w, score[i, j], tree.ids[box][j]))
                self.waiting += len(i)
        if self.waiting >= self.kth.size * self.k:  # as many as may be kept at all
            self._settle()

    def _settle(self) -> None:
        """Keep the best k of each window, ties by the smaller id, and raise the k-th scores."""
        if not self.fresh:
            return
        key, score, ids = (np.concatenate(c) for c in zip(self.held, *self.fresh, strict=True))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.searchsorted(key, key)
        place = np.arange(len(key)) - first
        last = key[place == self.k - 1]
        self.kth.reshape(-1)[last] = np.maximum(self.kth.reshape(-1)[last], score[place == self.k - 1])
        keep = place < self.k
        self.held, self.fresh, self.waiting = [key[keep], score[keep], ids[keep]], [], 0


def _anchors(leaves: DataFrame) -> DataFrame:
    """The rows of the leaves that are asked for: anchor (a number of its own), id, label, dim, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asked = np.frombuffer(r["is_asked"], bool)
                x = np.frombuffer(r["vectors"], r["type"]).astype(np.float64).reshape(r["n"], r["dim"])[asked]
                ids, labels = (np.frombuffer(r[c], np.int64)[asked] for c in ("id", "label"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(np.full(len(ids), r["dim"], np.int32)), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "label", "dim", "vector"])

    found = leaves.where("asked > 0").mapInArrow(run, "id long, label long, dim int, vector binary")
    return found.withColumn("anchor", F.monotonically_increasing_id())


def _found(leaves: DataFrame, shared: Broadcast, k: int, same: bool) -> DataFrame:
    """Candidates of the anchors of a block: the best k of each window in each task, and so the best k of all among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        asked: dict[int, list[tuple[np.ndarray, Asked]]] = {}
        for dim in np.unique(block["dim"]).tolist():
            every = np.flatnonzero(block["dim"] == dim)
            for at in range(0, len(every), TOGETHER):
                own = every[at : at + TOGETHER]
                q = np.array([np.frombuffer(block["vector"][i], np.float64) for i in own]).reshape(len(own), dim)
                asked.setdefault(dim, []).append((own, Asked(q, block["id"][own], block["label"][own], block["low"][own], block["high"][own], block["kth"][own], k, same)))

        def search(chunk: list[dict]) -> None:
            tree = Tree(chunk)
            for _, anchors in asked.get(chunk[0]["dim"], []):
                anchors.search(tree)

        chunk: list[dict] = []
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                for leaf in batch.slice(at, CHUNK).to_pylist():
                    if chunk and (len(chunk) == CHUNK or chunk[0]["dim"] != leaf["dim"]):
                        search(chunk)
                        chunk = []
                    chunk.append(leaf)
        if chunk:
            search(chunk)
        for own, anchors in (x for groups in asked.values() for x in groups):
            key, score, ids = anchors.held
            i, w = own[key // anchors.low.shape[1]], key % anchors.low.shape[1]
            columns = [block["anchor"][i], block["id"][i], w.astype(np.int32), block["positive_id"][i, w], block["positive_score"][i, w], ids, score]
            for at in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], [f.split()[0] for f in _FOUND.split(", ")])

    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    columns = "dim", "n", "type", "low", "high", "vectors", "id", "label"
    return leaves.select(*columns).mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _asked(leaves: DataFrame, pilot: DataFrame | None, block: dict[str, np.ndarray], k: int, same: bool) -> DataFrame:
    """The best k rows of each window of a block of anchors, over all leaves."""
    spark = leaves.sparkSession
    block = block | {"kth": np.full(block["low"].shape, _LEAST, np.int64)}
    if pilot is not None:
        place = {a: i for i, a in enumerate(block["anchor"].tolist())}
        for r in _found(pilot, spark.sparkContext.broadcast(block), k, same).where(F.col("rank") == k).select("anchor", "window", "score").collect():  # one row a window at most
            block["kth"][place[r["anchor"]], r["window"]] = r["score"]
    return _found(leaves, spark.sparkContext.broadcast(block), k, same)


def mine_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, block_rows: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label (a whole number), embedding (numbers); ``anchor`` tells its anchors. Components become
    floor(scale * x). Positives are an anchor's best rows of its label under another vec_id; negatives of a positive are the
    best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores
    come first, ties by the smaller vec_id. Rows with a null vec_id or label, a null vector, or a component that is null or
    not finite take no part; vectors of another length than the anchor's have no score with it. A repeated row counts as
    often as it stands there, and so does a repeated anchor. Scores beyond a long are the nearest long. No anchors, no
    positives or an empty table give no rows. Other columns do not matter.
    """
    spark = rows.sparkSession
    flag = unused("asked", rows.columns)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn(flag, F.coalesce(anchor, F.lit(False))).where("vec_id is not null and label is not null and embedding is not null").where(finite)
    leaves = written(packed_leaves(rows.select("vec_id", "label", "embedding", flag), F.col(flag), scale), "leaves")
    anchors = written(_anchors(leaves), "anchors")
    blocks = -(-anchors.count() // block_rows)
    pilot = leaves.where(F.pmod(F.xxhash64("low", "high", "n"), F.lit(PILOT)) == 0) if leaves.count() > 16 * PILOT else None
    done = []
    for number in range(blocks):
        table = anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == number).toArrow()  # about block_rows
        block = {c: table[c].to_numpy() for c in ("anchor", "id", "label", "dim")} | {"vector": table["vector"].to_pylist()}
        n = len(block["anchor"])
        none = np.zeros((n, 1), np.int64)
        wide = {"low": np.full((n, 1), _LEAST, np.int64), "high": np.full((n, 1), _MOST, np.int64), "positive_id": none, "positive_score": none}
        block |= {"low": np.ones((n, positives), np.int64), "high": np.zeros((n, positives), np.int64), "positive_id": np.zeros((n, positives), np.int64), "positive_score": np.zeros((n, positives), np.int64)}
        place = {a: i for i, a in enumerate(block["anchor"].tolist())}
        for r in _asked(leaves, pilot, block | wide, positives, True).select("anchor", "rank", "id", "score").collect():  # positives rows an anchor at most
            at = place[r["anchor"]], r["rank"] - 1
            block["positive_id"][at], block["positive_score"][at] = r["id"], r["score"]
            block["low"][at], block["high"][at] = max(-(-low * r["score"] // 100), _LEAST + 1), min(high * r["score"] // 100, _MOST)
        found = _asked(leaves, pilot, block, negatives, False).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        done.append(written(found, "negatives"))
    forget(leaves, anchors)
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    every = done[0]
    for table in done[1:]:
        every = every.unionByName(table)
    return every
