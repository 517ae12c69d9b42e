"""Quality rules with n-gram perplexity bands.

A modified Kneser-Ney model over text units (UTF-16, ORDER of them a gram, so that a gram is exactly one 64-bit key)
is counted by Spark over all documents of a language. Discounts, continuation counts and interpolated
probabilities are DataFrame joins on the counts. The result is stored in sorted arrays of keys, and every whole text
is scored against them. A document outside its language's band of perplexity is rejected; the band lies a multiple of the
spread beyond the quartiles of all documents of the language, where equal texts count once.

The arrays are broadcast only up to MODEL_BYTES; a larger model stays a table: its distinct grams are scored by joins and then
joined to the documents' grams, of which the commonest, at most COMMON by definition, are broadcast. Values are double precision in both and
perplexities rounded to PLACES, so that a model's size does not change a verdict.

Defined cases: a null or empty text has no words and fails the base rules; a very long text is scored whole; a null language is the
language ""; equal texts of a language score alike; a perplexity on a band's end is inside; repeated rows are judged separately; an
empty table gives no rows; columns other than doc_id, text and lang are carried by ``keep_good`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ORDER = 4
UNIT_BITS = 16
START, END = 2, 3
#: Grams of more than one unit that occur (below the highest order: follow) so often at most are pruned, so that a text's own rare grams do not speak for it.
PRUNED = 1
#: Bytes of model arrays that may be broadcast; beyond, scoring joins. The driver, which sorts them, takes some ROW_BYTES a row of the model for a while.
MODEL_BYTES = 64 << 20
#: Bytes of a row of the model in the arrays (a key and a value), and on the driver (as Arrow, as a frame and in the arrays).
ARRAY_BYTES, ROW_BYTES = 16, 160
#: Grams that are more than one in COMMON of all: there are fewer than COMMON of them.
COMMON = 10_000
#: Languages whose one row each may be broadcast; with more, such tables are joined.
MOST_LANGUAGES = 10_000
#: Decimal places of log perplexities.
PLACES = 9
#: The band: quartiles of the language's log perplexity, widened by this many interquartile ranges.
BELOW, ABOVE = 3.5, 5.25
#: Least interquartile range, for languages of few or nearly equal texts: ten steps, less than any language of many texts has.
LEAST_SPREAD = 0.02
#: Steps of a log perplexity of 1 that the quartiles are counted in.
GRID = 500
#: Units of text that a pass counts or scores (a longer text is a pass of its own), grams that are looked up at once, and distinct grams that a task holds.
CHUNK_UNITS, LOOKED_UP, _MOST_COUNTED = 1 << 19, 1 << 17, 1_000_000
SYMBOLS = b"#*$%&|<>"

MODEL = "lang string, size int, kind string, key long, value double"


# ---- grams of texts


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Units of the texts, each after ORDER - 1 start units and before an end unit, and where each text begins."""
    pad = np.full(ORDER - 1, START, dtype=np.uint16)
    end = np.array([END], dtype=np.uint16)
    parts, at = [], [0]
    for t in texts:
        own = np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2")
        parts += [pad, own, end]
        at.append(at[-1] + len(own) + ORDER)
    return np.concatenate(parts) if parts else np.empty(0, np.uint16), np.array(at)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams of the texts, text by text, and where each text's begin. A key holds the last unit lowest."""
    u, at = units(texts)
    wide = u.astype(np.uint64)
    key = wide.copy()
    for back in range(1, ORDER):
        key[back:] |= wide[:-back] << np.uint64(UNIT_BITS * back)
    target = np.ones(len(u), dtype=bool)
    for k in range(ORDER - 1):
        target[at[:-1] + k] = False
    first = at - np.arange(len(at)) * (ORDER - 1)
    return key[target].view(np.int64), first


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[int], list[str]]]:
    """(language, row numbers, texts) of a batch, about CHUNK_UNITS of text each."""
    langs = [x or "" for x in batch.column("lang").to_pylist()]
    texts = [x or "" for x in batch.column("text").to_pylist()]
    order = sorted(range(len(langs)), key=lambda i: langs[i])
    held, size = [], 0
    for i in order:
        if held and (langs[held[0]] != langs[i] or size + len(texts[i]) > CHUNK_UNITS):
            yield langs[held[0]], held, [texts[k] for k in held]
            held, size = [], 0
        held.append(i)
        size += len(texts[i])
    if held:
        yield langs[held[0]], held, [texts[k] for k in held]


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)

    def emit():
        for lang, parts in held.items():
            keys, n = merged(parts)
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[i : i + 100_000]), pa.string()), pa.array(keys[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["lang", "key", "n"])

    for batch in rows:
        for lang, _, texts in _by_language(batch):
            keys, n = np.unique(grams(texts)[0], return_counts=True)
            held.setdefault(lang, []).append((keys, n.astype(np.int64)))
            size += len(keys)
            if size > _MOST_COUNTED:
                held = {k: [merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > _MOST_COUNTED // 2:
                    yield from emit()
                    held, size = {}, 0
    yield from emit()


def counts(docs: DataFrame) -> DataFrame:
    """lang, key and n of all grams of all documents; summed in each task first."""
    return docs.select("text", "lang").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


# ---- the model


def _discount(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(table: DataFrame) -> DataFrame:
    """lang, d1, d2 and d3 of a table of counts, from how many grams have the counts 1 to 4 (0.5, 1 and 1.5 where one of these is none)."""
    of = table.groupBy("lang").agg(*(F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    fine = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    clipped = lambda d, k, other: F.when(fine, F.greatest(F.lit(0.05), F.least(F.lit(float(k)), d))).otherwise(other)
    return of.select(
        "lang",
        clipped(1 - 2 * y * F.try_divide("n2", "n1"), 1, 0.5).alias("d1"),
        clipped(2 - 3 * y * F.try_divide("n3", "n2"), 2, 1.0).alias("d2"),
        clipped(3 - 4 * y * F.try_divide("n4", "n3"), 3, 1.5).alias("d3"),
    )


def _low(size: int) -> int:
    """The mask of a gram's last ``size`` units."""
    return (1 << (UNIT_BITS * size)) - 1


def model(counted: DataFrame) -> DataFrame:
    """Rows of MODEL from counts(): log p of grams of each size, and log weights of contexts' lower orders."""
    tables = {ORDER: counted}
    for size in range(ORDER - 1, 0, -1):  # a lower gram counts what it follows
        tables[size] = tables[size + 1].groupBy("lang", F.col("key").bitwiseAND(_low(size)).alias("key")).agg(F.count("*").alias("n"))
    lower, out = None, []
    for size in range(1, ORDER + 1):
        discounts = common.hinted(common.cut(_discounts(tables[size]), f"discounts_{size}"), MOST_LANGUAGES)
        table = tables[size].join(discounts, "lang").withColumn("context", F.shiftrightunsigned("key", UNIT_BITS))
        # What is left to a gram after the discount; nothing where it is pruned, which then falls to the lower orders.
        own = F.when((F.col("n") <= PRUNED) & F.lit(size > 1), 0.0).otherwise(F.col("n") - _discount(F.col("n")))
        table = table.withColumn("left", own)
        context = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(F.col("n") - F.col("left")).alias("held"), F.count("*").alias("kinds"))
        joined = table.join(context, ["lang", "context"])
        if lower is None:
            share = 1 / (F.col("kinds") + 1)  # one unit more for all that was never seen
        else:
            joined = joined.withColumn("low", F.col("key").bitwiseAND(_low(size - 1))).join(lower.select("lang", F.col("key").alias("low"), "p"), ["lang", "low"])
            share = F.col("p")
        own = joined.select("lang", "key", "left", (F.col("left") / F.col("total") + F.col("held") / F.col("total") * share).alias("p"))
        lower = common.cut(own, f"grams_{size}")
        out.append(lower.where(F.col("left") > 0).select("lang", F.lit(size).alias("size"), F.lit("gram").alias("kind"), "key", F.log("p").alias("value")))
        rest = F.log(F.col("held") / F.col("total")) - (F.log(F.col("kinds") + 1) if size == 1 else F.lit(0.0))
        out.append(context.select("lang", F.lit(size).alias("size"), F.lit("rest").alias("kind"), F.col("context").alias("key"), rest.alias("value")))
    all_rows = out[0]
    for x in out[1:]:
        all_rows = all_rows.unionByName(x)
    return common.cut(all_rows, "model")


class Arrays:
    """A model as sorted arrays: keys and values of each language, gram size and kind."""

    def __init__(self, table: pa.Table):
        import pandas as pd

        self.parts: dict[tuple[str, int, str], tuple[np.ndarray, np.ndarray]] = {}
        frame: pd.DataFrame = table.to_pandas()
        for name, own in frame.groupby(["lang", "size", "kind"]):
            order = np.argsort(own["key"].to_numpy(), kind="stable")
            self.parts[name] = own["key"].to_numpy()[order], own["value"].to_numpy()[order]

    def _find(self, lang: str, size: int, kind: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys (0 where there is none) and which there are."""
        known, values = self.parts.get((lang, size, kind), (np.empty(0, np.int64), np.empty(0)))
        if not len(known):
            return np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        there = known[at] == keys
        return np.where(there, values[at], 0.0), there

    def log_p(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """log p of each gram: of its longest known suffix, with the weights of the contexts left behind."""
        return np.concatenate([self._log_p(lang, keys[i : i + LOOKED_UP]) for i in range(0, len(keys), LOOKED_UP)] or [np.zeros(0)])

    def _log_p(self, lang: str, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for size in range(ORDER, 0, -1):
            own = keys[todo] & np.int64(_low(size)) if size < ORDER else keys[todo]
            value, there = self._find(lang, size, "gram", own)
            out[todo[there]] += value[there]
            todo, own = todo[~there], own[~there]
            if not len(todo):
                break
            out[todo] += self._find(lang, size, "rest", (own.view(np.uint64) >> np.uint64(UNIT_BITS)).view(np.int64))[0]
        return out


# ---- base rules and scores

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_units long, log_p double"
_NAMES = [x.split()[0] for x in FEATURES.split(", ")]
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1


def base_features(texts: list[bytes]) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    out = np.zeros((len(texts), 5), dtype=np.int64)
    for i, j in common.batches(texts, CHUNK_UNITS):
        words = common.Words(texts[i:j])
        lead = np.concatenate([[0], np.cumsum((words.bytes & 0xC0) != 0x80)])
        chars = np.concatenate([[0], np.cumsum(lead[words.ends] - lead[words.starts])])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.bytes])])
        out[i:j, 0] = np.diff(words.offsets)
        out[i:j, 1] = np.diff(chars[words.offsets])
        out[i:j, 2] = np.diff(symbols[words.text_at])
        for d in range(j - i):
            lines = [x for x in texts[i + d].split(b"\n") if x.strip()]
            out[i + d, 3] = len(lines) - len(set(lines))
            own = words.hashes[words.offsets[d] : words.offsets[d + 1]]
            if len(own) > 3:
                _, at, n = np.unique(common.shingle_hashes(own, 3), return_inverse=True, return_counts=True)
                twice = np.flatnonzero(n[at] > 1)
                out[i + d, 4] = len(np.unique(np.concatenate([twice, twice + 1, twice + 2])))
    return out


def _measured(arrays):
    """A function of a text and its language: a struct of FEATURES. arrays: a broadcast of Arrays, or None where the score is joined."""

    @F.arrow_udf(f"struct<{FEATURES.replace(', ', ',').replace(' ', ':')}>")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, langs in columns:
            whole = pa.RecordBatch.from_arrays([texts, langs], names=["text", "lang"])
            out = [_measure(whole.slice(i, 1024), arrays and arrays.value) for i in range(0, len(texts), 1024)]
            yield pa.concat_arrays(out) if out else pa.array([], _MEASURED)

    return run


_MEASURED = pa.struct([(x.split()[0], pa.float64() if x.endswith("double") else pa.int64()) for x in FEATURES.split(", ")])


def _measure(part: pa.RecordBatch, arrays: Arrays | None) -> pa.StructArray:
    base = base_features(common.as_bytes(part.column("text")))
    total, score = np.zeros(part.num_rows, dtype=np.int64), np.full(part.num_rows, np.nan)
    for lang, numbers, texts in _by_language(part):
        keys, first = grams(texts)
        total[numbers] = np.diff(first)
        if arrays is not None:
            score[numbers] = np.add.reduceat(arrays.log_p(lang, keys), first[:-1])
    columns = [*(pa.array(base[:, k]) for k in range(5)), pa.array(total), pa.array(score, from_pandas=True)]
    return pa.StructArray.from_arrays(columns, fields=list(_MEASURED))


def _document_grams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids = batch.column("row").to_numpy()
        for lang, numbers, texts in _by_language(batch):
            keys, first = grams(texts)
            for number, a, b in zip(numbers, first[:-1], first[1:], strict=True):
                own, n = np.unique(keys[a:b], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), ids[number])), pa.array([lang] * len(own), pa.string()), pa.array(own), pa.array(n)], names=["row", "lang", "key", "n"])


def gram_scores(counted: DataFrame, table: DataFrame) -> DataFrame:
    """lang, key and log_p of each distinct gram, by joins with a model of any size."""
    found, total = counted.select("lang", "key"), F.lit(0.0)
    for size in range(1, ORDER + 1):
        own = F.col("key").bitwiseAND(_low(size)) if size < ORDER else F.col("key")
        for kind, key in (("gram", own), ("rest", F.shiftrightunsigned(own, UNIT_BITS))):
            part = table.where((F.col("size") == size) & (F.col("kind") == kind)).select("lang", F.col("key").alias("k"), F.col("value").alias(f"{kind}_{size}"))
            found = found.withColumn("k", key).join(part, ["lang", "k"], "left").drop("k")
        total = F.coalesce(f"gram_{size}", F.coalesce(f"rest_{size}", F.lit(0.0)) + total)
    return found.select("lang", "key", total.alias("gram_log_p"))


def joined_scores(rows: DataFrame, counted: DataFrame, table: DataFrame) -> DataFrame:
    """row and log_p of documents (row, text, lang). A gram that is in nearly every document meets them by a broadcast, not in one task."""
    scores = common.cut(gram_scores(counted, table), "gram_scores")
    all_grams = counted.agg(F.sum("n").alias("n")).first()[0] or 0
    often = common.cut(counted.where(F.col("n") * COMMON > all_grams).select("lang", "key").join(scores, ["lang", "key"]).select("lang", "key", F.col("gram_log_p").alias("common_log_p")), "common")
    grams_of = rows.mapInArrow(_document_grams, "row long, lang string, key long, n long").join(F.broadcast(often), ["lang", "key"], "left")
    known = grams_of.where("common_log_p is not null").select("row", "n", F.col("common_log_p").alias("x"))
    other = grams_of.where("common_log_p is null").join(scores, ["lang", "key"]).select("row", "n", F.col("gram_log_p").alias("x"))
    return known.union(other).groupBy("row").agg(F.sum(F.col("n") * F.col("x")).alias("log_p"))


def scored(rows: DataFrame, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """rows (text, lang and others) and FEATURES. The documents are read twice: to be counted and to be scored."""
    spark, name = rows.sparkSession, common.fresh(rows.columns, "features")
    counted = common.cut(counts(rows), "gram_counts")
    table = model(counted)
    if table.count() * ARRAY_BYTES <= model_bytes:
        arrays = spark.sparkContext.broadcast(Arrays(table.toArrow()))
        own = rows.withColumn(name, _measured(arrays)("text", "lang"))
        return own.withColumns({x: F.col(f"{name}.{x}") for x in _NAMES}).drop(name)
    number = common.fresh(rows.columns, "number")
    own = common.cut(rows.withColumn(number, F.monotonically_increasing_id()), "numbered")
    scores = joined_scores(own.select(F.col(number).alias("row"), "text", "lang"), counted, table).select(F.col("row").alias(number), "log_p")
    own = own.withColumn(name, _measured(None)("text", "lang"))
    return own.withColumns({x: F.col(f"{name}.{x}") for x in _NAMES[:-1]}).drop(name).join(scores, number, "left").drop(number)


def with_verdict(features: DataFrame) -> DataFrame:
    """features with log_ppl, base_failed and kept; the bands come from all documents that the base rules keep, copies (of one log_ppl) counted once."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    log_ppl = F.round(-F.col("log_p") / F.col("n_units"), PLACES)
    own = common.cut(features.withColumn("base_failed", failed).withColumn("log_ppl", log_ppl).withColumn("language", F.coalesce("lang", F.lit(""))), "features")
    once = own.where(~failed).select("language", "log_ppl").distinct()
    steps = once.groupBy("language", F.round(F.col("log_ppl") * GRID).cast("long").alias("step")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("language").orderBy("step")
    share = steps.withColumn("share", F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("language")))
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("step"))) / GRID
    bands = share.groupBy("language").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD))
    bands = bands.select("language", (F.col("q1") - BELOW * wide).alias("lower"), (F.col("q3") + ABOVE * wide).alias("upper"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    return own.join(common.hinted(common.cut(bands, "bands"), MOST_LANGUAGES), "language", "left").withColumn("kept", kept)


def rules(docs: DataFrame, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """doc_id, the base features, base_failed, kept, log_ppl and the language's band of each document."""
    features = scored(docs.select("doc_id", "text", "lang"), model_bytes).drop("text")
    return with_verdict(features).select("doc_id", *_NAMES[:5], "base_failed", "kept", "log_ppl", "lower", "upper")


def keep_good(docs: DataFrame, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """The documents that the rules keep, with their columns. Other columns than text and lang never reach Python."""
    rows = docs.select("text", "lang", F.struct(*common.quoted(docs.columns)).alias("doc"))
    return with_verdict(scored(rows, model_bytes).drop("text")).where("kept").select("doc.*")


def op5_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
