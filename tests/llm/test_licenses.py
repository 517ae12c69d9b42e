"""License scans: the query against plain Python, merged diagonals on planted copies, and awkward rows."""

import re

import pytest
from helpers import awkward, empty

from locusframe.llm import licenses, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    """n_words, places of phrases, their labels, all labels and score, template by template and place by place."""
    w, k, places, base, labels, score = words_of(text), licenses.GRAM, [], set(), set(), 0.0
    for label, template, exact in licenses.TEMPLATES:
        t = template.split()
        votes = {}
        for i in range(len(w) - k + 1):
            for j in range(len(t) - k + 1):
                if w[i : i + k] == t[j : j + k]:
                    votes.setdefault(i - j, set()).add(j)
        for d in votes:
            near = [votes[e] for e in votes if abs(e - d) <= (0 if exact else licenses.SHIFT)]
            share = len({j + o for v in near for j in v for o in range(k)}) / len(t)
            if exact and share == 1:
                places.append(d)
                base.add(label)
            if share == 1 or not exact and share >= licenses.LEAST:
                labels.add(label)
                score = max(score, share)
    return len(w), places, ",".join(sorted(base)), ",".join(sorted(labels)), score


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        n, places, base, labels, score = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(places, default=None), max(places, default=None)), r.doc_id
        assert (r.base_labels, r.labels, r.score) == (base, labels, score), r.doc_id


def test_query_on_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(registry.queries()["op11_diagonal_licenses"](spark, sf_dir).collect(), texts)


def test_planted_copies(spark):
    long = licenses.NOTICES[1][1]
    texts = [
        "CC-BY-NC cc by nc. (CC BY) NC/4.0", "under the MIT license under the mit License", "under the the mit license", "Apache License,\nVersion 2.0", "apache licence version 2",
        long, long.replace("free of charge ", "free of any charge "), long.replace("granted free", "granted and so free"), " ".join(long.split()[:23]), " ".join(long.split()[:12]), "x " + long + " y " + long.upper(),
        "under the MİT license", "apacħe license version 2", "cc byé nc", "CC by ncK", "apache license version 2K", "under the mit license\x00released under the mit license", "the software " * 400 + long, "cc by nc" * 3, "cc by nc " * 3000,
        "un​der the mit license", "UNDER_THE_MIT_LICENSE", "under the mit license", "2cc by nc", "Kkk under the mit license K",
    ]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    check(rows, dict(enumerate(texts)))
    got = {r.doc_id: r for r in rows}
    assert got[6].labels == got[7].labels == got[8].labels == "mit" and got[9].labels == "" and got[17].labels == "mit" and got[19].n_base == 3000


def test_spans_cover_the_copies(spark):
    long = licenses.NOTICES[1][1]
    text = f"a b c {long} d e {long.replace('free of charge', 'free of all charge')} f"
    n = len(long.split())
    got = sorted((r.first_word, r.last_word, r.label) for r in licenses.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    assert got == [(3, 2 + n, "mit"), (5 + n, 5 + 2 * n, "mit")]


def test_awkward_rows_and_empty_tables(spark):
    df = awkward(spark)
    rows = licenses.scan(df).collect()
    assert len(rows) == df.count() and {r.doc_id for r in rows} == {r.doc_id for r in df.collect()}
    check([r for r in rows if r.doc_id not in (6, None)], {r.doc_id: r.text for r in df.collect() if r.doc_id not in (6, None)})
    assert licenses.scan(empty(spark)).count() == 0 and licenses.spans(empty(spark)).count() == 0
    clash = df.selectExpr("doc_id", "text", "1 as `row`", "2 as own", "3 as template", "4 as n_words", "5 as size", "6 as `DIAGONAL`")
    assert licenses.scan(clash).count() == df.count()
    null = spark.createDataFrame([(None, "under the mit license"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_base for r in licenses.scan(null).collect()) == [0, 1]


def test_templates_are_bounded(spark):
    for bad in ([("x", "two words", True)], [("x", "wörds of three", False)], [("x", "w " * (licenses.MOST_WORDS + 1), False)]):
        with pytest.raises(ValueError):
            licenses.template_grams(spark, bad)


def test_nothing_leaves_the_jvm(spark, sf_dir):
    plan = registry.queries()["op11_diagonal_licenses"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
