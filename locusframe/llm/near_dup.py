"""Near-duplicate groups by SetSketch registers.

A document is the set of its k-word shingles. Each set gets a SetSketch: exponentially spaced, truncated minima
(base B, rate A), which merge by maximum and agree in a register about as often as sets overlap. Bands of
registers bring candidates together, the joint likelihood of two sketches drops what is far below the threshold,
and what is left is verified on the full sets. Links join into components.

No group is ever expanded into pairs. Equal sets are one node. Nodes of a bucket of SMALL at most are candidates with
each other, those of a larger one with its hub, the most central node, which joins nearly all. Of the candidates, each node is first
verified with one, that with the most candidates of its own; what this joins into components needs no other text, and only candidates
that are still apart are verified after. What is still apart in a large bucket is settled in blocks of two chunks of CHUNK nodes, of sizes
that the threshold allows: a task compares a block's sketches at once and returns the nodes that may be linked, and the texts of these
alone are dealt to the blocks again, where their sets are compared and only links that join components returned. So every two nodes
that share a bucket are compared or already joined, and a link at the threshold shares no bucket with a chance under 5e-8.

Buckets, copies of one text and components that hold more than one in OFTEN of all rows are dealt to several tasks where rows look them up
(``common.spread_join``); thin joins on pairs are left to Spark's splitting of skewed partitions.

Defined cases: a null text, or one without words, is an empty set: linked with nothing, its own component, kept; a text of
fewer than k words is one shingle; a very long text is one set, made in a pass of its own; repeated rows are of one component; a null doc_id counts as larger than all others; an
empty table gives no rows; other columns are carried by ``deduplicate`` and not read here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import mix64

REGISTERS, BANDS, ROWS = 128, 32, 4
B, A, TOP = 1.001, 20.0, (1 << 16) - 2
#: Standard errors below the threshold from which an estimate drops a candidate.
SLACK = 6
#: Nodes of a bucket whose pairs are compared one by one, at most.
SMALL = 12
#: Rows whose ids may be broadcast to pick their texts; more are joined.
MOST_WANTED = 1_000_000
#: Texts that a task compares with one hub.
SPOKES = 64
#: Nodes of a chunk, about. A block is two chunks, whatever a bucket's size.
CHUNK = 4096
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOG_B = np.log(B)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Letters A-Z count as lower case."""
    out = []
    for i, j in common.batches(texts):
        words = common.Words([t.lower() for t in texts[i:j]])  # bytes.lower() leaves all but A-Z
        for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
            out.append(np.unique(common.shingle_hashes(words.hashes[a:b], k)))
    return out


def _points(elements: np.ndarray, owner: np.ndarray, limit: np.ndarray, best: np.ndarray) -> None:
    """Lowers best[owner, register] by each element's points below its limit.

    An element's points are a Poisson process of rate REGISTERS, a register drawn for each: so its first point in
    each register is exponential with rate 1, independent between registers, and in ascending order a few points decide.
    """
    reached = np.zeros(len(elements))
    first, step = 0, 1
    while len(elements):
        z = mix64(elements[:, None] + np.arange(first + 1, first + step + 1, dtype=np.uint64) * _GOLDEN)
        gaps = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / REGISTERS
        at = reached[:, None] + np.cumsum(gaps, axis=1)
        use = at < limit[:, None]
        rows, _ = np.nonzero(use)
        np.minimum.at(best, (owner[rows], (z[use] & np.uint64(REGISTERS - 1)).astype(np.int64)), at[use])
        alive = use[:, -1]
        elements, owner, limit, reached = elements[alive], owner[alive], limit[alive], at[alive, -1]
        first, step = first + step, min(2 * step, max(1, (1 << 20) // max(1, len(elements))))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16) of each set, a row each; an empty set's are 0."""
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    margin = np.log(REGISTERS) + 3
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        best = np.full((len(todo), REGISTERS), np.inf)
        _points(np.concatenate([sets[i] for i in todo]), np.repeat(np.arange(len(todo)), sizes), np.repeat(margin / sizes, sizes), best)
        done = np.isfinite(best).all(axis=1)
        k = np.floor(1 - np.log(best[done] / A) / _LOG_B)
        out[todo[done]] = np.clip(k, 0, TOP + 1).astype(np.uint16)
        todo, margin = todo[~done], margin * 2
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's registers."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, r.shape[:2])
    for i in range(ROWS):
        h = mix64(h ^ r[:, :, i]) + _GOLDEN
    return h.view(np.int64)


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes, from how often registers are above, below and equal."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-x * (B - 1) / B) / _LOG_B

    def likelihood(j):
        up, down = p(np.maximum(u - v * j, 1e-12)), p(np.maximum(v - u * j, 1e-12))
        return above * np.log(up) + below * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), most.astype(np.float64)
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _sketch(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = common.as_bytes(batch.column("text"))
            for i, j in common.batches(texts, common.CHUNK_BYTES // 2):
                sets = shingle_sets(texts[i:j], k)
                registers = sketches(sets)
                sums = [(int(s.sum(dtype=np.uint64)), int(mix64(s ^ _GOLDEN).sum(dtype=np.uint64))) for s in sets]
                hashes = np.array(sums, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[i:j], pa.array(map(len, sets), pa.int64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([r.tobytes() for r in registers], pa.binary())],
                    names=["row", "n", "s1", "s2", "sketch"],
                )

    return run


def _bands(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            registers = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            node = np.repeat(part.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(registers).ravel()), pa.array(node)], names=["bucket", "node"])


def _likely(threshold: float):
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
            n_a, n_b = batch.column("n_a").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float)
            keep = (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9) & (joint_similarity(a, b, n_a, n_b) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verify(k: int, percent: int):
    """Links of rows (hub, salt, spoke, row, text) in which each hub comes before its spokes: those whose sets are as like as asked."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, dtype=np.uint64)
        for batch in rows:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                keep = []
                for spoke, mine in zip(part.column("spoke").to_pylist(), shingle_sets(common.as_bytes(part.column("text")), k), strict=True):
                    if spoke:
                        both = len(np.intersect1d(own, mine, assume_unique=True))
                        keep.append(100 * both >= percent * (len(own) + len(mine) - both))
                    else:
                        own = mine
                        keep.append(False)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("hub")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


BLOCK = ["bucket", "left_class", "left_chunk", "right_class", "right_chunk"]
_BLOCK_TYPES = "bucket long, left_class int, left_chunk int, right_class int, right_chunk int"


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of rows sorted by BLOCK, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in BLOCK], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if held and tuple(keys[i]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = tuple(keys[i])
    if held:
        yield pa.Table.from_batches(held)


def _apart(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sides and labels of a block's nodes, and the places of those that are not of its commonest label: every pair to compare has one of them. Nodes of a block of two chunks are compared over the sides only."""
    side, label = block.column("side").to_numpy(), block.column("label").to_numpy()
    kinds, at, n = np.unique(label, return_inverse=True, return_counts=True)
    return side if side.min() != side.max() else np.arange(len(side)), at, np.flatnonzero(at != n.argmax())


def _maybe(threshold: float):
    """Of a block, the nodes whose registers agree with those of a node of another label as often as the threshold lets expect, less SLACK standard errors. Sizes that the threshold rules out are not compared."""
    least = REGISTERS * (threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(rows):
            n = block.column("n").to_numpy()
            block = block.take(pa.array(np.argsort(n, kind="stable")))
            n = np.sort(n)
            side, label, others = _apart(block)
            registers = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            found = np.zeros(len(side), dtype=bool)
            low, high = np.searchsorted(n, n * threshold - 1e-6), np.searchsorted(n, n / threshold + 1e-6, side="right")
            for i in others:
                a, b = low[i], high[i]
                near = ((registers[a:b] == registers[i]).sum(axis=1) >= least) & (side[a:b] != side[i]) & (label[a:b] != label[i])
                found[a:b] |= near
                found[i] |= near.any()
            if found.any():
                yield from block.select([*BLOCK, "side", "node", "label"]).filter(pa.array(found)).to_batches()

    return run


def _spanning(k: int, percent: int):
    """The pairs of nodes of a block, counted by an index of its shingles. Returns links that join labels, no more than it takes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(rows):
            sets = shingle_sets(common.as_bytes(block.column("text").combine_chunks()), k)
            out = _links(block.column("node").to_numpy(), *_apart(block), sets, percent)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _links(node: np.ndarray, side: np.ndarray, label: np.ndarray, others: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    sizes, label = np.array([len(s) for s in sets]), label.copy()
    begin = np.concatenate([[0], np.cumsum(sizes)])
    tokens, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(at, kind="stable")]  # of each token in turn
    first = np.cumsum(times) - times
    out = []
    for i in others:
        own = at[begin[i] : begin[i + 1]]
        n = times[own]
        ends = np.cumsum(n)
        places = np.arange(ends[-1]) + np.repeat(first[own] - (ends - n), n)
        both = np.bincount(owners[places], minlength=len(sets))
        linked = ((100 + percent) * both >= percent * (sizes[i] + sizes)) & (side != side[i]) & (label != label[i])
        for j in np.flatnonzero(linked):
            if label[i] != label[j]:
                out.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
    return out


def contracted(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after joining the labels that edges (a, b: nodes) link. Each label hooks to its smallest neighbour, chains are shortened by doubling, until no edge is left."""
    spark, total = labels.sparkSession, labels.count()
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").select(F.greatest("label_a", "label_b").alias("hi"), F.least("label_a", "label_b").alias("lo")).where("hi <> lo").distinct()
    between, path = common.cut_at(between, "edges")
    while not between.isEmpty():
        hook, hook_path = common.cut_at(between.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks")
        while True:
            up = hook.select(F.col("hi").alias("lo"), F.col("lo").alias("up"))
            jumped, jumped_path = common.cut_at(hook.join(up, "lo", "left").select("hi", F.coalesce("up", "lo").alias("lo"), F.col("up").isNotNull().alias("moved")), "hooks")
            moved = not jumped.where("moved").isEmpty()
            common.drop_table(spark, hook_path)
            hook, hook_path = jumped.select("hi", "lo"), jumped_path
            if not moved:
                break
        to = lambda c: hook.select(F.col("hi").alias(c), F.col("lo").alias(f"{c}_to"))
        sizes = labels.groupBy("label").agg(F.count("*").alias("times"))
        moved = sizes.join(to("label"), "label")  # a row a label that moves; its nodes may be any share of all
        labels, _ = common.cut_at(common.spread_join(labels, moved, ["label"], F.col("times") * common.OFTEN > total, "node", "left").select("node", F.coalesce("label_to", "label").alias("label")), "labels")
        ends = between.join(to("hi"), "hi", "left").join(to("lo"), "lo", "left").select(F.coalesce("hi_to", "hi").alias("x"), F.coalesce("lo_to", "lo").alias("y"))
        between, new = common.cut_at(ends.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).where("hi <> lo").distinct(), "edges")
        common.drop_table(spark, path)
        path = new
    return labels


class Groups:
    """Components of rows (row, doc_id, text, ...) that common.numbered gives: ``members`` has row, node, n and label (null node: an empty set)."""

    def __init__(self, rows: DataFrame, k: int, percent: int):
        self.spark, self.rows, self.k, self.percent = rows.sparkSession, rows, k, percent
        marked, path = common.cut_at(rows.select("row", "text").mapInArrow(_sketch(k), "row long, n long, s1 long, s2 long, sketch binary"), "sketches")
        equal = marked.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("node"), F.count("*").alias("times")).where("times > 1")
        equal, equal_path = common.cut_at(equal, "equal")
        many = F.col("times") * common.OFTEN > marked.count()
        known = common.spread_join(marked.drop("sketch"), equal, ["s1", "s2", "n"], many, "row", "left")
        self.members = common.cut(known.select("row", F.when(F.col("n") > 0, F.coalesce("node", "row")).alias("node"), "n"), "members")
        common.drop_table(self.spark, equal_path)
        self.total = self.members.count()
        #: node, n, sketch: a row a distinct set
        first = self.members.where("row = node").select("row")
        self.nodes, nodes_path = common.cut_at(marked.select("row", "n", "sketch").join(first, "row", "left_semi").select(F.col("row").alias("node"), "n", "sketch"), "nodes")
        common.drop_table(self.spark, path)
        self.labels = self._linked()
        common.drop_table(self.spark, nodes_path)

    def _linked(self) -> DataFrame:
        """labels (node, label) of all nodes that share a bucket with another."""
        bands = self.nodes.mapInArrow(_bands, "bucket long, node long")
        shared, shared_path = common.cut_at(bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        many = F.col("size") * common.OFTEN > self.total
        buckets, buckets_path = common.cut_at(common.spread_join(bands, shared, ["bucket"], many, "node"), "buckets")
        common.drop_table(self.spark, shared_path)
        labels = common.cut(buckets.select("node").distinct().withColumn("label", F.col("node")), "labels")
        small, large = buckets.where(F.col("size") <= SMALL), buckets.where(F.col("size") > SMALL)
        pairs = small.select("bucket", F.col("node").alias("a")).join(small.select("bucket", F.col("node").alias("b")), "bucket").where("a < b").select("a", "b")
        central = large.groupBy("node").agg(F.sum("size").alias("score"))
        hubs = large.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("score", "node")).alias("hub"), F.first("size").alias("members"))
        hubs, hubs_path = common.cut_at(hubs, "hubs")
        often = F.col("members") * common.OFTEN > self.total
        spokes = common.spread_join(large, hubs, ["bucket"], often, "node").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        labels = self._verified(pairs.union(spokes).distinct(), labels)
        common.drop_table(self.spark, hubs_path)
        labels = self._settled(large, labels)
        common.drop_table(self.spark, buckets_path)
        return labels

    def _verified(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """labels after the links among candidate pairs (a, b)."""
        of = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        likely, path = common.cut_at(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_likely(self.percent / 100), "a long, b long"), "likely")
        ends = likely.select(F.col("a").alias("x"), F.col("b").alias("y")).union(likely.select(F.col("b").alias("x"), F.col("a").alias("y")))
        degree, degree_path = common.cut_at(ends.groupBy("y").agg(F.count("*").alias("degree")), "degrees")
        many = F.col("degree") * common.OFTEN > self.total
        best = common.spread_join(ends, degree, ["y"], many, "x").groupBy("x").agg(F.max_by("y", F.struct("degree", -F.col("y"))).alias("y"))
        labels = self._joined(best.where("x <> y"), labels)
        label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        apart = likely.join(label("a"), "a").join(label("b"), "b").where("label_a <> label_b")
        labels = self._joined(apart.select(F.col("a").alias("x"), F.col("b").alias("y")), labels)
        for p in (path, degree_path):
            common.drop_table(self.spark, p)
        return labels

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """row and text of the wanted rows (a written table)."""
        return self.rows.select("row", "text").join(common.hinted(wanted, MOST_WANTED), "row", "left_semi")

    def _joined(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """labels after the links among pairs (x, y) that their full sets confirm.

        The pairs of each y are a star. Its texts come together in one task, or, y's with them, in one for every SPOKES: no text travels but to its stars.
        """
        pairs, path = common.cut_at(pairs, "pairs")
        sizes = pairs.groupBy("y").agg(F.count("*").alias("degree")).withColumn("salts", F.ceil(F.col("degree") / SPOKES).cast("int"))
        salted = common.spread_join(pairs, sizes, ["y"], F.col("degree") * common.OFTEN > self.total, "x")
        spokes = salted.select(F.col("x").alias("row"), F.col("y").alias("hub"), F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("spoke"))
        hubs = sizes.select(F.col("y").alias("row"), F.col("y").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("spoke"))
        needed, needed_path = common.cut_at(spokes.union(hubs), "needed")
        texts = self.rows.select("row", "text").join(common.hinted(needed, MOST_WANTED), "row").select("hub", "salt", "spoke", "row", "text")
        stars = texts.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "spoke")
        links, links_path = common.cut_at(stars.mapInArrow(_verify(self.k, self.percent), "a long, b long"), "links")
        out = labels if links.isEmpty() else contracted(labels, links)
        for p in (path, needed_path, links_path):
            common.drop_table(self.spark, p)
        return out

    def _settled(self, large: DataFrame, labels: DataFrame) -> DataFrame:
        """labels after the links between what is still apart in large buckets."""
        opened = large.join(labels, "node")
        differ = opened.groupBy("bucket").agg(F.min("label").alias("u"), F.max("label").alias("v")).where("u <> v").select("bucket")
        size_class = F.when(F.col("size") > CHUNK, F.floor(F.log("n") / float(-np.log(self.percent / 100 - 1e-6)))).otherwise(0).cast("int")  # linked sets are of one class or of two that follow each other
        opened = opened.join(differ, "bucket", "left_semi").join(self.nodes, "node").select("bucket", "node", "label", "n", "sketch", size_class.alias("class"))
        opened, opened_path = common.cut_at(opened, "open_buckets")
        if opened.isEmpty():
            return labels
        sizes = opened.groupBy("bucket", "class").agg(F.count("*").alias("times"))
        of = sizes.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("times") / CHUNK).cast("int")))).alias("chunks"), F.sum("times").alias("members"))
        of, of_path = common.cut_at(of, "chunks")  # classes follow the logarithm of a set's size: a row a bucket is short
        many = F.col("members") * common.OFTEN > self.total
        placed = common.spread_join(opened, of, ["bucket"], many, "node")
        placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")[F.col("class")]).cast("int"))
        own, chunk, chunks = F.col("class"), F.col("chunk"), F.col("chunks")
        other = lambda c, made: F.transform(F.sequence(F.lit(0), F.coalesce(F.try_element_at(chunks, c), F.lit(0))), lambda j: F.when(j < F.coalesce(F.try_element_at(chunks, c), F.lit(0)), made(j)))
        block = lambda a, i, b, j, side: F.struct(a.alias("left_class"), i.alias("left_chunk"), b.alias("right_class"), j.alias("right_chunk"), side.alias("side"))
        within = other(own, lambda j: block(own, F.least(chunk, j), own, F.greatest(chunk, j), F.when(chunk <= j, 0).otherwise(1)))
        above = other(own + 1, lambda j: block(own, chunk, own + 1, j, F.lit(0)))
        below = other(own - 1, lambda j: block(own - 1, j, own, chunk, F.lit(1)))
        dealt = placed.withColumn("block", F.explode(F.concat(within, above, below))).where("block is not null").select("bucket", "node", "label", "n", "sketch", "block.*")
        types = f"{_BLOCK_TYPES}, side int, node long, label long"
        maybe = dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "node").select(*BLOCK, "side", "node", "label", "n", "sketch").mapInArrow(_maybe(self.percent / 100), types)
        maybe, maybe_path = common.cut_at(maybe, "maybe")
        if not maybe.isEmpty():
            wanted, wanted_path = common.cut_at(maybe.select(F.col("node").alias("row")).distinct(), "wanted")
            texts = self._texts(wanted).withColumnRenamed("row", "node")
            again = maybe.join(texts, "node").repartition(*BLOCK).sortWithinPartitions(*BLOCK, "node").select(*BLOCK, "side", "node", "label", "text")
            links, links_path = common.cut_at(again.mapInArrow(_spanning(self.k, self.percent), "a long, b long").distinct(), "links")
            if not links.isEmpty():
                labels = contracted(labels, links)
            common.drop_table(self.spark, wanted_path)
            common.drop_table(self.spark, links_path)
        for p in (opened_path, of_path, maybe_path):
            common.drop_table(self.spark, p)
        return labels

    def components(self) -> DataFrame:
        """row, n, label: equal labels are one component (null: an empty set)."""
        return self.members.join(self.labels, "node", "left").select("row", "n", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document."""
    row = common.fresh(docs.columns, "row")
    rows = common.numbered(docs, row).select(F.col(row).alias("row"), "doc_id", "text")
    own = common.cut(Groups(rows, k, percent).components().join(rows.select("row", "doc_id"), "row"), "components")
    first = own.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1")
    out = common.spread_join(own, first, ["label"], F.col("times") * common.OFTEN > own.count(), "row", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: that of the smallest doc_id, of equal ones the first row."""
    row = common.fresh(docs.columns, "row")
    whole = common.numbered(docs, row)
    rows = whole.select(F.col(row).alias("row"), "text", "doc_id")
    own = common.cut(Groups(rows, k, percent).components().join(rows.select("row", "doc_id"), "row"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = own.where("label is not null").groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1")
    many = F.col("times") * common.OFTEN > own.count()
    gone = common.spread_join(own, first, ["label"], many, "row").where("row <> first.row").select(F.col("row").alias(row))
    gone = common.hinted(common.cut(gone, "gone"), MOST_WANTED)  # fewer than what stays; the documents are shuffled only where it is more than may be broadcast
    return whole.join(gone, row, "left_anti").select(*common.quoted(docs.columns))


def op2_setsketch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)
