"""Similarity self-join of documents on word n-grams: Jaccard at or above a threshold.

Copies are joined first, by a hash of their words. A MinHash LSH forest then finds candidates. Each tree is the prefix
trie of its own signatures, held as sorted rows: documents under one node stand together, and what two neighbours share
is the node they meet at. How far matches are shortened, from whole signatures (``DEEPEST`` values) on, follows from the
threshold alone: to the longest prefix at which a pair at the threshold meets in some tree with the target recall. What
adapts to the data is a node that holds more than ``BLOCK`` documents at that length: it is parted where its neighbours
share least, so that its parts keep longer prefixes. Under each node all signatures are
compared, and pairs whose whole signatures agree too little to be similar are let go there, so chance meetings never
chain. Where the parts of an over-full node did not end up in one component, all pairs under that node are compared as
well, in blocks, so the parting loses none. What stays is verified exactly, by the intersections of n-gram sets, in blocks of bounded size that Spark deals
out; a block sends back each document's number of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklogs.llm.common import Words, binary_array, expand, mix, rolling, signed, slices, word_hashes, written
from sparklogs.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEEPEST = 12
RECALL = 0.9999
BLOCK = 256
BLOCK_BYTES = 16 << 20
FILTER_BITS = 1 << 26
_CELLS = 1 << 22
_SALT = mix(np.arange(1, 2 * TREES * DEEPEST + 1, dtype=np.uint64))
_XOR, _TIMES = _SALT[::2].astype(np.uint32), _SALT[1::2].astype(np.uint32) | np.uint32(1)
_LEAST = -(2**63)


def forest_depth(threshold: float, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix at which documents as similar as ``threshold`` share one in some tree with probability ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_agreement(threshold: float, values: int = TREES * DEEPEST) -> float:
    """The share of equal signature values that a pair at the threshold misses only beyond five standard deviations."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / values)


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each text, and where each text's begin; a shorter text is one run."""
    own = word_hashes(words, 2)
    size = np.diff(words.first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    start = expand(words.first[:-1], count)
    end = np.minimum(start + n, np.repeat(words.first[1:], count))
    return rolling(12).runs(own, start, end), np.concatenate([[0], np.cumsum(count)])


def minhashes(grams: np.ndarray, first: np.ndarray, values: int = TREES * DEEPEST) -> np.ndarray:
    """(texts, values) of 16 bits each: the least of the salted hashes of a text's grams; zeros for a text without one."""
    out = np.zeros((len(first) - 1, values), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        low, at = (grams >> np.uint64(32)).astype(np.uint32), first[:-1][full]
        for k in range(values):
            least = np.minimum.reduceat((low ^ _XOR[k]) * _TIMES[k], at)
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def signatures(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """id (doc_id, null as the least value), hash (of the text), node (a number of the row), c1 and c2 (hash of the words),
    grams (number of runs), size (bytes) and signature (all values of all trees)."""
    schema = "id long, hash long, node long, c1 long, c2 long, grams long, size long, signature binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                words = Words(part.column("text"))
                raw = words.raw.tobytes()
                same = b"".join(xxhash.xxh3_128_digest(b" ".join(raw[a:b].split())) for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True))
                same = np.frombuffer(same, "<i8").reshape(-1, 2)
                grams, first = shingles(words, n)
                values = minhashes(grams, first)
                kept = binary_array(values.view(np.uint8).reshape(-1), np.full(len(values), values.shape[1] * 2))
                columns = [*(pa.array(np.ascontiguousarray(c)) for c in (same[:, 0], same[:, 1], np.diff(first), np.diff(words.at))), kept]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), *columns], names)

    rows = docs.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("node"), "text")
    return rows.mapInArrow(run, schema)


def part_node(shared: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut the sorted rows of a node into parts of ``most`` rows; ``shared[i]`` is how much row i shares with row i + 1.

    A part ends where neighbours share least, as late as possible, and the next begins with its last row, so no
    neighbours are torn apart.
    """
    parts, low, n = [], 0, len(shared) + 1
    while n - low > most:
        window = shared[low : low + most - 1]
        cut = low + len(window) - int(np.argmin(window[::-1]))  # rows low .. cut - 1, then a row that shares least
        parts.append((low, cut + 1))
        low = cut
    return [*parts, (low, n)]


def trie_nodes(depth: int, most: int) -> Callable:
    """A mapInArrow function over rows sorted by (tree, values): the documents that meet at each node, as (meeting, node, whole).

    ``meeting`` comes from the set of documents, so the same ones get the same number in every tree. A node of more than
    ``most`` documents meets in parts; ``whole`` (null elsewhere) is the number of that node on all rows of its parts. No
    more than ``most`` rows and a batch are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        going = False  # the held rows go on with a node of which parts are out

        def out(groups: list[tuple[np.ndarray, int | None]]) -> Iterator[pa.RecordBatch]:
            if groups:
                size = [len(g) for g, _ in groups]
                number = [int(mix(g.view(np.uint64)).sum(dtype=np.uint64)) for g, _ in groups]
                meeting = np.repeat(np.array(number, np.uint64), size)
                whole = pa.array([w for _, w in groups], pa.int64()).take(pa.array(np.repeat(np.arange(len(groups)), size)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(meeting)), pa.array(np.concatenate([g for g, _ in groups])), whole], ["meeting", "node", "whole"])

        def name(tree: int, value: np.ndarray) -> int:
            return xxhash.xxh3_64_intdigest(value[:depth].tobytes(), int(tree)) - (1 << 63)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            tree, node = table["tree"].to_numpy(), table["node"].to_numpy()
            values = np.frombuffer(buffer_of(table["values"].chunk(0)), np.uint16).reshape(len(node), -1)
            equal = values[1:] == values[:-1]
            shared = np.where(equal.all(axis=1), values.shape[1], equal.argmin(axis=1)) * (tree[1:] == tree[:-1])
            cut = np.concatenate([[0], np.flatnonzero(shared < depth) + 1])
            groups: list[tuple[np.ndarray, int | None]] = []
            for k in np.flatnonzero(np.diff(cut) > 1).tolist():
                low, end = int(cut[k]), int(cut[k + 1])
                whole = name(tree[low], values[low]) if end - low > most or (going and not k) else None
                groups.extend((node[low + a : low + b], whole) for a, b in part_node(shared[low : end - 1], most) if b - a > 1)
            last = int(cut[-1])
            going &= not last
            if len(node) - last > most:  # an open node that is too large: all but its last part are done
                parts, whole, going = part_node(shared[last:], most), name(tree[last], values[last]), True
                groups.extend((node[last + a : last + b], whole) for a, b in parts[:-1])
                last += parts[-1][0]
            yield from out(groups)
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if len(table) > 1:
                value = np.frombuffer(table["values"][0].as_py(), np.uint16)
                yield from out([(table["node"].to_numpy(), name(table["tree"][0].as_py(), value) if going else None)])

    return run


def buffer_of(column: pa.BinaryArray) -> memoryview:
    """All bytes of a binary column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)
    return memoryview(data)[at[column.offset] : at[column.offset + len(column)]] if data is not None else memoryview(b"")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        key = np.stack([table[k].to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for a symmetric matrix of links."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root, len(linked)).min(axis=1, initial=len(linked)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _alike(least: float) -> Callable:
    """A mapInArrow function over rows sorted by meeting: a spanning forest of the pairs whose signatures agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[np.ndarray] = []
        size = 0
        for rows in _groups(batches, ["meeting"]):
            rows = rows.combine_chunks()
            node = rows["node"].to_numpy()
            values = np.frombuffer(buffer_of(rows["signature"].chunk(0)), np.uint16).reshape(len(node), -1)
            linked = np.stack([(values == v).mean(axis=1) >= least for v in values])
            root = roots(linked)
            off = np.flatnonzero(root != np.arange(len(node)))
            edges.append(np.stack([node[root[off]], node[off]]))
            size += len(off)
            if size > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(edges, axis=1)], ["a", "b"])
                edges, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(edges, axis=1)], ["a", "b"])

    return run


def _across(least: float) -> Callable:
    """A mapInArrow function over rows sorted by (whole, i, j): which components have pairs whose signatures agree enough.

    All rows of block i are compared with all of block j, but for those whose components are joined already. What comes
    out is a forest over the components of a group.
    """

    def group(rows: pa.Table) -> list[tuple[int, int]]:
        rows = rows.combine_chunks()
        component, block = rows["component"].to_numpy(), rows["block"].to_numpy()
        values = np.frombuffer(buffer_of(rows["signature"].chunk(0)), np.uint16).reshape(len(component), -1)
        two = rows["i"][0].as_py() != rows["j"][0].as_py()
        left, right = np.flatnonzero(block == rows["i"][0].as_py()), np.flatnonzero(block == rows["j"][0].as_py())
        label, found = np.unique(component, return_inverse=True)[1], []
        for k, row in enumerate(left.tolist()):
            other = right if two else right[k + 1 :]
            other = other[label[other] != label[row]]
            if not len(other):
                continue
            other = other[np.count_nonzero(values[other] == values[row], axis=1) >= least * values.shape[1]]
            for at in other[np.unique(label[other], return_index=True)[1]].tolist():
                found.append((component[row], component[at]))
                label[label == label[at]] = label[row]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["whole", "i", "j"]):
            found = group(rows)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def joined_across(near: DataFrame, over: DataFrame, firsts: DataFrame, least: float, width: int) -> DataFrame:
    """``near`` (node, component) with the components joined that similar signatures under one over-full node link.

    ``over`` (whole, node) are the documents of such nodes. A node of one component has nothing more to join; all pairs of
    any other are compared, in blocks of ``width`` documents that Spark deals out.
    """
    placed = over.join(near, "node", "left").select("whole", "node", F.coalesce("component", "node").alias("component"))
    sets = placed.groupBy("whole").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark"), F.min("component").alias("low"), F.max("component").alias("high"))
    once = sets.where("low <> high").groupBy("n", "mark").agg(F.min("whole").alias("whole"))  # the same documents in other trees
    placed = written(placed.join(once.select("whole", F.ceil(F.col("n") / width).cast("int").alias("blocks")), "whole"), "placed")
    if placed.isEmpty():
        return near
    hashed = F.xxhash64("node").alias("hash")
    asked = holding(firsts.select("node", "signature", hashed), placed.select(hashed)).drop("hash")
    placed = placed.join(asked, "node").withColumn("block", F.pmod(F.xxhash64("node", "whole"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "whole", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "signature"
    )
    keys = ["whole", "i", "j"]
    links = written(dealt.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_across(least), "a long, b long"), "across")
    if links.isEmpty():
        return near
    top = components(links)
    raised = near.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return raised.unionByName(top.join(near, "node", "left_anti").select("node", "component"))


def candidates(firsts: DataFrame, threshold: float, recall: float) -> DataFrame:
    """node and component of (node, signature): pairs which may be similar lie in one component."""
    width = 2 * DEEPEST
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = firsts.select("node", tree, "signature").select("tree", F.expr(f"substring(signature, tree * {width} + 1, {width})").alias("values"), "node")
    depth, least = forest_depth(threshold, recall=recall), least_agreement(threshold)
    dealt = rows.repartition("tree", F.substring("values", 1, 2 * depth)).sortWithinPartitions("tree", "values", "node")
    meetings = written(dealt.mapInArrow(trie_nodes(depth, BLOCK), "meeting long, node long, whole long"), "meetings")
    met = meetings.select("meeting", "node").distinct().join(firsts.select("node", "signature"), "node").repartition("meeting").sortWithinPartitions("meeting", "node")
    near = components(met.mapInArrow(_alike(least), "a long, b long"))
    over = meetings.where("whole is not null").select("whole", "node").distinct()
    return near if over.isEmpty() else joined_across(near, over, firsts, least, 8 * BLOCK)


def holding(rows: DataFrame, keys: DataFrame, key: str = "hash") -> DataFrame:
    """``rows`` whose 64-bit ``key`` may be one of those of ``keys``: all that are, and hardly any other.

    The keys are sent to the scan as a bitmap of ``FILTER_BITS`` bits, so what a later join would drop is not shuffled.
    """
    place = keys.select((F.col(key).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("place"))
    cells = place.groupBy(F.bitmap_bucket_number("place").alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)  # 8 MB
    for row in cells:
        bits[(row["cell"] - 1) * 4096 : row["cell"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(key).to_numpy() & (FILTER_BITS - 1)
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))

    return rows.mapInArrow(keep, rows.schema)


def _links_in(texts: list[str], side: np.ndarray | None, n: int, threshold: float) -> np.ndarray:
    """Which texts of a block are linked; where two blocks meet, ``side`` tells the block and only pairs across count."""
    m = len(texts)
    grams, first = shingles(Words(pa.array(texts, pa.large_string())), n)
    _, which = np.unique(grams, return_inverse=True)
    pair = np.unique(which * m + np.repeat(np.arange(m), np.diff(first)))
    gram, text = pair // m, pair % m
    size = np.bincount(text, minlength=m).astype(np.float64)
    shared = np.bincount(gram) > 1
    column = np.cumsum(shared) - 1
    keep = shared[gram]
    gram, text = column[gram[keep]], text[keep]
    common, step = np.zeros((m, m), np.float32), max(1, _CELLS // m)
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(gram, (low, low + step))
        cells = np.zeros((m, min(step, int(shared.sum()) - low)), np.float32)
        cells[text[a:b], gram[a:b] - low] = 1
        common += cells @ cells.T
    linked = common.astype(np.float64) * (1 + threshold) >= threshold * (size[:, None] + size) - 1e-6
    linked &= ~np.eye(m, dtype=bool) if side is None else side[:, None] != side
    return linked


def _verify(n: int, threshold: float) -> Callable:
    """A mapInArrow function over rows sorted by (component, i, j): exact links inside each group."""

    def group(rows: pa.Table) -> tuple:
        _, once = np.unique(rows["node"].to_numpy(), return_index=True)  # repeated rows bring their text several times
        rows = rows.take(pa.array(once))
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        side = rows["block"].to_numpy() if rows["i"][0].as_py() != rows["j"][0].as_py() else None  # one of two blocks may be empty
        linked = _links_in(rows["text"].to_pylist(), side, n, threshold)
        return node, linked.sum(axis=1), linked @ copies, node[roots(linked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for rows in _groups(batches, ["component", "i", "j"]):
            found.append(group(rows))
            if len(found) == 1024:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], ["node", "links", "linked", "root"])

    return run


def ngram_join(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_of, copies, n_links, n_linked_docs, class_hash.

    ``class_id`` is the least doc_id that links lead to; ``copy_of`` the least doc_id with the same words; ``copies`` how
    many rows have them; ``n_links`` the number of different texts linked to this one (Jaccard of word runs at least
    ``threshold``), ``n_linked_docs`` the rows that have those texts. ``class_hash`` is the xxhash64 of the text that
    stands for the class under ``class_id``. A text of fewer than ``n`` words is one run; texts without words (null,
    empty) are copies of each other and link to none. A null doc_id stands first and gives a null class_id. Texts are
    told apart by themselves, not by doc_id, so different texts under one doc_id each have their own links and class;
    repeated rows count as copies. An empty table gives no rows.
    """
    rows = written(signatures(docs, n), "signatures")
    texts = rows.groupBy("c1", "c2").agg(F.min(F.struct("id", "hash", "node")).alias("at"), F.count("*").alias("copies"))
    texts = written(texts.select("c1", "c2", "at.*", "copies"), "texts")
    firsts = written(rows.where("grams > 0").select("node", "signature").join(texts.select("node"), "node", "left_semi"), "firsts")
    near = candidates(firsts, threshold, recall)

    members = near.join(texts.select("node", "id", "hash", "copies"), "node").join(rows.select("node", "size"), "node")
    members = written(members, "members")
    need = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.least(F.count("*"), F.ceil(F.sum("size") / F.lit(BLOCK_BYTES))))
    blocks = members.groupBy("component").agg(need.cast("int").alias("blocks"))
    members = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the text of a document goes once to each block that its own block meets
    read = docs.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = holding(read, members.select("hash")).join(members, ["id", "hash"])
    dealt = chosen.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "text"
    )
    keys = ["component", "i", "j"]
    checked = dealt.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_verify(n, threshold), "node long, links long, linked long, root long")
    checked = written(checked, "checked")
    degree = checked.groupBy("node").agg(F.sum("links").alias("n_links"), F.sum("linked").alias("n_linked_docs"))
    classes = components(checked.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    placed = classes.join(texts.select("node", "id", "hash"), "node")
    heads = placed.groupBy("component").agg(F.min(F.struct("id", "hash")).alias("head"))
    known = degree.join(classes.join(heads, "component").select("node", "head"), "node", "left")

    null_id = lambda c: F.when(c != _LEAST, c)
    named = texts.join(known, "node", "left").select(
        "c1", "c2", F.col("id").alias("copy_of"), "copies", F.coalesce("head", F.struct("id", "hash")).alias("head"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"),
    )
    return rows.select("id", "c1", "c2").join(named, ["c1", "c2"]).select(
        null_id(F.col("id")).alias("doc_id"), null_id(F.col("head.id")).alias("class_id"), null_id(F.col("copy_of")).alias("copy_of"), "copies",
        "n_links", "n_linked_docs", F.col("head.hash").alias("class_hash"),
    )
