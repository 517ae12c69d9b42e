"""Merkle manifest of a dataset, with a proof of every row.

Rows are leaves of a ternary tree a source, and the sources' roots are leaves of a tree of their own. A tree is cut into aligned
blocks of ARITY ** BLOCK_LEVELS leaves. A task takes a block at a time and walks through its leaves: at each level it holds the
authentication nodes of the leaf it is at and a treehash stack that prepares those of the next run. At every leaf the
stacks take a few more leaves, that with the lowest open node first, so that when the walk enters a run its nodes are there; of inner nodes it
holds a few a level. The blocks' roots are leaves again, of a tree 729 times smaller; the paths from there up are made first and appended to those of the block.

Leaves get their places from a sort by ranges and the counts of the ranges before, so a source may hold any share of the rows. Blocks,
not sources, are dealt to tasks. Only ids and digests are shuffled.

Defined cases: a null value is hashed as ``-``, an empty text as ``0:``; null doc_ids come first, rows of one doc_id in order of their leaves, and equal
rows are leaves of their own; a null source is a source, the first; a lone leaf is its source's root and a lone source's root is the root, with an empty proof;
a null doc_id is not tampered with; an empty table gives no rows; columns other than those hashed are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ARITY, BLOCK_LEVELS = 3, 6
#: Ranges of the sort, times their keys, whose counts may be broadcast; more are joined.
MOST_RANGES = 1_000_000
#: Leaves that a task takes at least, where there are so many: the small trees on top are written by few tasks.
TASK_ROWS = 20_000

Path = list[tuple[int, list[str]]]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- The walk through a block


class Stack:
    """A treehash stack: the nodes of a level over leaves [at, end), made from left to right. It holds fewer than ARITY open nodes a level."""

    def __init__(self, leaves: list[str], level: int, at: int, end: int):
        self.leaves, self.level, self.at, self.end = leaves, level, at, min(end, len(leaves))
        self.open: list[list[str]] = [[] for _ in range(level)]
        self.nodes: list[str] = []

    @property
    def done(self) -> bool:
        return self.at >= self.end

    def lowest(self) -> int:
        """The level of its lowest open node; the one it makes where none is open."""
        return next((i for i, x in enumerate(self.open) if x), self.level)

    def _put(self, level: int, node: str) -> None:
        if level == self.level:
            self.nodes.append(node)
            return
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        node = digest(*self.open[level])
        self.open[level].clear()
        self._put(level + 1, node)

    def step(self) -> None:
        """Takes a leaf. The last leaf of all closes the runs that it leaves short."""
        self._put(0, self.leaves[self.at])
        self.at += 1
        if self.at == len(self.leaves):
            for level in range(self.level):
                if self.open[level]:
                    self._close(level)

    def finish(self) -> list[str]:
        while not self.done:
            self.step()
        return self.nodes


def height(n: int, most: int = BLOCK_LEVELS) -> int:
    """Levels above n leaves, at most those of a block."""
    h = 0
    while h < most and ARITY**h < n:
        h += 1
    return h


def block_root(leaves: list[str], levels: int) -> str:
    return Stack(leaves, levels, 0, len(leaves)).finish()[0]


def walk(leaves: list[str], levels: int) -> Iterator[Path]:
    """The path of each leaf in turn, as far as the root of a block of so many levels: at each level, the leaf's place in its run and the other nodes of it."""
    width = [ARITY**i for i in range(levels + 1)]
    # the nodes on the right of the first leaf's path, and stacks for the runs that follow
    run = [["", *Stack(leaves, i, width[i], width[i + 1]).finish()] for i in range(levels)]
    ahead = [Stack(leaves, i, width[i + 1] + width[i], 2 * width[i + 1]) for i in range(levels)]
    for at, leaf in enumerate(leaves):
        path = []
        for i in range(levels):
            place = at // width[i] % ARITY
            path.append((place, run[i][:place] + run[i][place + 1 :]))
        yield path
        # what this leaf completes: its run's parent stands on the left from now on, and the run makes way for the one prepared
        node, level = leaf, 0
        while level < levels:
            run[level][at // width[level] % ARITY] = node
            if (at + 1) % width[level + 1]:
                break
            node = digest(*run[level])
            begin = at + 1 + width[level + 1]
            run[level] = ["", *ahead[level].finish()]
            ahead[level] = Stack(leaves, level, begin + width[level], begin + width[level + 1])
            level += 1
        # each level needs ARITY - 1 leaves out of ARITY; the stack with the lowest open node goes first
        for _ in range(-(-levels * (ARITY - 1) // ARITY)):
            waiting = [s for s in ahead if not s.done]
            if not waiting:
                break
            min(waiting, key=Stack.lowest).step()


def fold(leaf: str, path: Path) -> str:
    """The root that a leaf and its path give."""
    for place, others in path:
        leaf = digest(*others[:place], leaf, *others[place:])
    return leaf


def proof(path: Path) -> str:
    return digest(*(x for _, others in path for x in others))


def written(path: Path) -> str:
    return ";".join(f"{place}:{','.join(others)}" for place, others in path)


def parsed(path: str) -> Path:
    return [(int(level[0]), level[2:].split(",") if len(level) > 2 else []) for level in path.split(";")] if path else []


# ---- Leaves


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The digest of doc_id, source, lang, n_chars and text."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*map(_field, own)), 256)


def leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """key (the source, null first), doc_id, tie, leaf and altered (the leaf of another text, null where it is the same)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    other = F.lit(None).cast("string") if altered is None else F.when(~altered.eqNullSafe(F.col("text")), leaf(altered))
    return docs.select(key.alias("key"), "doc_id", F.monotonically_increasing_id().alias("tie"), F.unhex(leaf()).alias("leaf"), F.unhex(other).alias("altered"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows (a written table) with at, the place within its key by order, and total, the rows of the key.

    Rows are sorted in ranges; a row's place is its place in the range and the counts of its key in the ranges before.
    """
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("id", F.monotonically_increasing_id())
    placed = _few(dealt, rows, "sorted").withColumn("range", F.shiftright("id", 33))
    own = placed.groupBy("range", "key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy("key")  # a row a range
    before = F.coalesce(F.sum("n").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = own.select("range", "key", (before - F.col("first")).alias("shift"), F.sum("n").over(of).alias("total"))
    return placed.join(common.hinted(counts, MOST_RANGES), ["range", "key"]).withColumn("at", F.col("id") + F.col("shift")).select("key", "at", "total", *[c for c in rows.columns if c not in ("key", "tie")])


def _few(made: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """made as a written table; where the table it comes from has few rows, by few tasks."""
    return common.cut(made.coalesce(max(1, -(-source.count() // TASK_ROWS))), name)


# ---- Trees


def _in_blocks(rows: DataFrame, levels: int) -> DataFrame:
    """rows with their block, each block whole and in order in one task."""
    own = rows.withColumn("block", F.floor(F.col("at") / F.lit(ARITY**levels)).cast("long")) if "block" not in rows.columns else rows
    return own.repartition("key", "block").sortWithinPartitions("key", "block", "at")


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block."""
    held: list[dict] = []
    for batch in rows:
        for row in batch.to_pylist():
            if held and (row["key"], row["block"]) != (held[0]["key"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_ROOTS = pa.schema([("key", pa.string()), ("at", pa.int64()), ("total", pa.int64()), ("leaf", pa.binary())])
_PATHS = pa.schema([("key", pa.string()), ("at", pa.int64()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string())])
_PROOFS = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
_TYPES = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_TYPES[f.type]}" for f in schema)


def roots(rows: DataFrame, levels: int) -> DataFrame:
    """key, at (the block), total (the key's blocks) and leaf, the root of each block of rows (key, at, total, leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for own in _blocks(batches):
                total = own[0]["total"]
                root = block_root([r["leaf"].hex() for r in own], height(total, levels))
                yield {"key": own[0]["key"], "at": own[0]["block"], "total": -(-total // ARITY**levels), "leaf": bytes.fromhex(root)}

        return _batches(each(), _ROOTS)

    return _in_blocks(rows.select("key", "at", "total", "leaf"), levels).mapInArrow(run, _ddl(_ROOTS))


def tree(rows: DataFrame, levels: int) -> list[DataFrame]:
    """rows (key, at, total, leaf), the roots of their blocks, the roots of these and so on: the last has a row a key."""
    out = [rows]
    while True:
        out.append(_few(roots(out[-1], levels), out[-1], "roots"))
        if out[-1].where("total > 1").isEmpty():
            return out


def _walked(rows: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The rows in blocks, each block after the row of above (key, at: the block, path, subroot, root)."""
    top = above.select("key", F.lit(-1).cast("long").alias("at"), F.col("at").alias("block"), "path", "subroot", "root")
    own = rows.withColumn("block", F.floor(F.col("at") / F.lit(ARITY**levels)).cast("long"))
    return _in_blocks(own.unionByName(top, allowMissingColumns=True), levels)


def _each(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[dict, dict, Path]]:
    """Each leaf, the row above its block and its whole path."""
    for top, *own in _blocks(batches):
        above = parsed(top["path"])
        known = [r["leaf"].hex() for r in own]
        for row, path in zip(own, walk(known, height(own[0]["total"], levels)), strict=True):
            yield row, top, path + above


def paths(rows: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """key, at, path, subroot and root of rows (key, at, total, leaf); above has those of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(({"key": row["key"], "at": row["at"], "path": written(path), "subroot": top["subroot"], "root": top["root"]} for row, top, path in _each(batches, levels)), _PATHS)

    return _walked(rows.select("key", "at", "total", "leaf"), above, levels).mapInArrow(run, _ddl(_PATHS))


def descended(levels_of: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """What stands above the blocks of the first table of a tree; above is what stands above its last."""
    for rows in reversed(levels_of[1:-1]):
        above = _few(paths(rows, above, levels), rows, "paths")
    return above


def proofs(rows: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the altered leaf, where there is one) and verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for row, top, path in _each(batches, levels):
                own = row["leaf"].hex()
                folded = fold(row["altered"].hex() if row["altered"] is not None else own, path)
                yield {"doc_id": row["doc_id"], "leaf": own, "subroot": top["subroot"], "root": top["root"], "proof_sha256": proof(path), "folded_root": folded, "verified": folded == top["root"]}

        return _batches(each(), _PROOFS)

    return _walked(rows.withColumn("doc_id", F.col("doc_id").cast("long")), above, levels).mapInArrow(run, _ddl(_PROOFS))


def manifest(docs: DataFrame, altered: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """A row a document: its leaf, its source's root, the root, a digest of its proof, and whether its text (altered, if given) still gives the root."""
    thin = common.cut(leaves(docs, altered), "leaves")
    rows = ranked(thin, "doc_id", "leaf", "tie")
    of_sources = tree(rows, levels)
    subroots = _few(of_sources[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), "leaf"), of_sources[-1], "subroots")
    sources = ranked(subroots, "source")
    of_all = tree(sources, levels)
    hexed = F.lower(F.hex("leaf"))
    top = of_all[-1].select("key", F.lit(0).cast("long").alias("at"), F.lit("").alias("path"), F.lit("").alias("subroot"), hexed.alias("root"))
    found = _few(paths(sources, descended(of_all, top, levels), levels), subroots, "paths")
    above = found.join(sources.select("at", "source", hexed.alias("own")), "at").select(F.col("source").alias("key"), F.lit(0).cast("long").alias("at"), "path", F.col("own").alias("subroot"), "root")
    return proofs(rows, descended(of_sources, _few(above, subroots, "paths"), levels), levels)


def without_newlines() -> Column:
    """The text as the check of the manifest alters it: without newlines where the checksum of the id is even."""
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), without_newlines())


def _sql(leaf_levels: int = 13, source_levels: int = 8) -> str:
    """Both trees level by level, for sources of 3 ** 13 rows and 3 ** 8 sources at most."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    own = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    steps = "list_reduce([xor(crc, b)] || range(8), lambda c, i: if(c % 2 = 1, xor(c // 2, 3988292384), c // 2))"
    crc = f"list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda crc, b: {steps})"
    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '') AS k, {own('text')} AS leaf, {own("replace(text, chr(10), '')")} AS other, {crc} % 2 = 1 AS even FROM documents)",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, count(*) OVER (PARTITION BY k) AS n, leaf AS h FROM d)",
    ]

    def levels(t: str, many: int) -> None:
        for i in range(many):
            parts.append(f"{t}{i + 1} AS MATERIALIZED (SELECT k, nth // 3 AS nth, if(any_value(n) = 1, any_value(h), sha256(string_agg(h, '' ORDER BY nth))) AS h, (any_value(n) + 2) // 3 AS n FROM {t}{i} GROUP BY k, nth // 3)")
            beside = lambda sign: f"coalesce(string_agg(y.h, '' ORDER BY y.nth) FILTER (y.nth {sign} x.nth), '')"
            parts.append(f"{t}s{i} AS MATERIALIZED (SELECT x.k, x.nth, x.n > 1 AS inner_, {beside('<')} AS lo, {beside('>')} AS hi FROM {t}{i} x JOIN {t}{i} y ON x.k = y.k AND x.nth // 3 = y.nth // 3 GROUP BY x.k, x.nth, x.n)")

    def folds(f: str, t: str, k: str, at: str, many: int) -> None:
        for i in range(many):
            parts.append(f"{f}{i + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (proof, x), proof || lo || hi AS proof, if(inner_, sha256(lo || x || hi), x) AS x FROM {f}{i} f JOIN {t}s{i} s ON s.k = f.{k} AND s.nth = f.{at} // {3**i})")

    levels("a", leaf_levels)
    parts.append(f"b0 AS MATERIALIZED (SELECT '' AS k, k AS source_key, h, row_number() OVER (ORDER BY k) - 1 AS nth, count(*) OVER () AS n FROM a{leaf_levels})")
    levels("b", source_levels)
    parts.append("f0 AS (SELECT doc_id, k, nth, leaf, '' AS proof, if(coalesce(even, false), other, leaf) AS x FROM a0)")
    folds("f", "a", "k", "nth", leaf_levels)
    parts.append(f"g0 AS (SELECT f.doc_id, f.leaf, f.proof, f.x, b.h AS subroot, '' AS top, b.nth AS place FROM f{leaf_levels} f JOIN b0 b ON b.source_key = f.k)")
    folds("g", "b", "top", "place", source_levels)
    return f"""WITH {", ".join(parts)} SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.h AS verified FROM g{source_levels}, b{source_levels} r"""


OP12_SQL = _sql()
