"""Helpers that the operators share: the shared folder, text batches and vectorised word hashes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch that Spark hands to Python: several columns of it are held at once, by the JVM too.
BATCH_BYTES = 4 << 20
#: The white space that ends a word, as in ``[^\x20\x09-\x0D]+``.
WHITE = bytes([0x20, *range(0x09, 0x0E)])

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run in one JVM (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    if (own := getattr(shared_dir, "own", None)) is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="locusframe-")
    return own


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def new_table(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, jpath = _filesystem(spark, path)
    fs.deleteOnExit(jpath)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    fs, jpath = _filesystem(spark, path)
    fs.delete(jpath, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, where they are not smaller yet; a longer text is a batch of its own."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage ends there and a lost executor costs nothing."""
    return cut_at(df, name)[0]


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of each row (a new column), the same whenever it is read.

    Rows of a Parquet table are numbered by their places in its files, so that nothing is copied; the rows of anything else are written first.
    """
    relation = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if relation and "_metadata" not in (c.lower() for c in docs.columns):
        with contextlib.suppress(AnalysisException):  # a format that does not tell places
            file, place = fresh(docs.columns, "file_"), fresh(docs.columns, "place_")
            told = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
            number = F.row_number().over(Window.orderBy(file)).cast("long")
            files = cut(told.select(file).distinct().select(file, number.alias(name)).coalesce(1), "files")  # a row a file
            return told.join(F.broadcast(files), file).withColumn(name, F.shiftleft(name, 33) + F.col(place)).drop(file, place)
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not among columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[Column]:
    """The columns of exactly these names, dots and spaces included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def hinted(table: DataFrame, most: int) -> DataFrame:
    """A written table, broadcast where it has no more than ``most`` rows; joins give the same rows either way."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


#: Tasks that a key is dealt to where it has a large share of the rows.
SALTS = 64
#: A key has a large share where it has more than one in OFTEN of the rows; there are fewer than OFTEN of them.
OFTEN = 1000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], often: Column, by: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of unique keys. A key for which ``often`` holds (few by its definition) is dealt to SALTS tasks by the column ``by``."""
    hot = F.broadcast(table.where(often).select(*keys).withColumn("hot_", F.lit(True)))
    salt = F.when(F.col("hot_"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = rows.join(hot, keys, "left").withColumn("salt_", salt).drop("hot_")
    copies = F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(table.withColumn("salt_", F.explode(copies)), [*keys, "salt_"], how).drop("salt_")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts of at most ``most`` bytes together, or of one longer text."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) > most:
            yield i, j
            i, total = j, 0
        total += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(WHITE)] = False
_BYTE[~_IS_WORD] = 0
_B = 0xD1342543DE82EF95
_B_INVERSE = pow(_B, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        out = []
        for base in (_B, _B_INVERSE):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        if n > 8 * CHUNK_BYTES:  # one huge text: not kept
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


class Words:
    """The words of some texts: a 64-bit hash each, where each text's begin, and their byte spans.

    ``offsets[d]:offsets[d + 1]`` are the words of text d. Words are maximal runs of bytes that
    are not ASCII white space, so in valid UTF-8 they are those of ``[^\\x20\\x09-\\x0D]+``.
    """

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts) + b"\n"
        self.bytes = raw = np.frombuffer(self.buffer, dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(lengths)])
        inside = _IS_WORD[raw].view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power(len(raw))
        total = np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)
        before = np.where(self.starts > 0, total[self.starts - 1], np.uint64(0))
        self.hashes = mix64((total[self.ends - 1] - before) * down[self.starts])
        self.offsets = np.searchsorted(self.starts, self.text_at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text, in order; with fewer words, the sequence as one."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    span = min(k, n)
    h = np.full(n - span + 1, span, dtype=np.uint64) * _GOLDEN
    for j in range(span):
        h = mix64(h ^ words[j : n - span + 1 + j]) + _GOLDEN
    return h


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
