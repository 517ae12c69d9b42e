"""Operators that carry the columns of documents carry any names of them."""

from helpers import AWKWARD
from pyspark.sql import functions as F

from locusframe.llm import near_dup, ordinal, perplexity, secrets

ODD = ["a.b", "my col", "source-url", "doc", "row", "kept", "number", "features", "estimate", "n_words", "language", "band", "label", "quality_kept"]


def odd(spark):
    words = " ".join(f"word{i} of" for i in range(40))
    rows = [(1000 + i, f"{words} {i} " + " ".join(f"own{i}x{k}" for k in range(30)), "en", i, *(f"{c}{i}" for c in ODD)) for i in range(12)]
    rows += [(r[0], r[1], r[2], None, *[None] * len(ODD)) for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD))


def same(out, docs, text=True):
    names = [c for c in docs.columns if text or c not in ("text", "n_chars")]
    of = lambda df: {r[0]: tuple(r) for r in df.select(*(F.col(f"`{c}`") for c in names)).collect()}
    ours, all_of = of(out), of(docs)
    assert out.columns == docs.columns and all(all_of[k] == v for k, v in ours.items())
    return set(ours)


def test_odd_names(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    assert same(ordinal.keep_good(docs, labels.limit(0)), docs) >= set(range(1000, 1012))
    same(ordinal.keep_good(docs, labels), docs)
    assert same(perplexity.keep_good(docs), docs) == same(perplexity.keep_good(docs, model_bytes=0), docs) == set(range(1000, 1012))
    assert same(near_dup.deduplicate(docs), docs) >= set(range(1000, 1012))
    assert same(secrets.redact(docs), docs, text=False) >= set(range(1000, 1012))


def test_verdicts_do_not_depend_on_the_size_of_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    of = lambda b: {r.doc_id: (r.kept, r.log_ppl, r.lower, r.upper) for r in perplexity.rules(docs, b).collect()}
    assert of(0) == of(perplexity.MODEL_BYTES)
