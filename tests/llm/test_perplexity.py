import math
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import awkward, empty

from locusframe.llm import perplexity as px


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_base_features_of_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = px.rules(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    good = [r for r in rows if not r.base_failed]
    assert sum(r.kept for r in good) > 0.98 * len(good)


class Brute:
    """Modified Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        self.n = {4: Counter(g for t in texts for g in self.grams(t))}
        for size in (3, 2, 1):
            self.n[size] = Counter(g[1:] for g in self.n[size + 1])
        self.d, self.total, self.held, self.kinds = {}, defaultdict(float), defaultdict(float), Counter()
        for size, table in self.n.items():
            of = Counter(table.values())
            if all(of[k] for k in (1, 2, 3, 4)):
                y = of[1] / (of[1] + 2 * of[2])
                self.d[size] = [min(k, max(0.05, k - (k + 1) * y * of[k + 1] / of[k])) for k in (1, 2, 3)]
            else:
                self.d[size] = [0.5, 1.0, 1.5]
            for g, c in table.items():
                self.total[size, g[:-1]] += c
                self.held[size, g[:-1]] += c - self.left(size, c)
                self.kinds[size, g[:-1]] += 1

    def left(self, size, c):
        return 0.0 if c == 0 or size > 1 and c == 1 else c - self.d[size][min(c, 3) - 1]

    @staticmethod
    def grams(t):
        u = "\x02\x02\x02" + t + "\x03"
        return [u[i - 3 : i + 1] for i in range(3, len(u))]

    def p(self, g):
        size = len(g)
        context = size, g[:-1]
        if context not in self.total:
            return self.p(g[1:])
        low = 1 / (self.kinds[context] + 1) if size == 1 else self.p(g[1:])
        c = self.n[size][g]
        return self.left(size, c) / self.total[context] + self.held[context] / self.total[context] * low

    def log_p(self, t):
        return sum(math.log(self.p(g)) for g in self.grams(t))


TEXTS = ["the cat sat on the mat and the dog ran", "a cat ran to the dog", "dogs and cats and mats", "", "the the the the", "zebra ünï", "that mat sat and that cat ran on", "on and on and on the cat"]


def test_model_and_both_scores_equal_brute_force(spark):
    rows = spark.createDataFrame([(i, t, t, "en") for i, t in enumerate(TEXTS)] + [(100, "qqq xyz", "qqq xyz", None)], "row long, doc string, text string, lang string")
    en = Brute(TEXTS)
    want = {i: en.log_p(t) for i, t in enumerate(TEXTS)} | {100: Brute(["qqq xyz"]).log_p("qqq xyz")}
    arrays = {r.row: r.log_p for r in px.scored(rows).collect()}
    joined = {r.row: r.log_p for r in px.scored(rows, model_bytes=0).collect()}
    for i, w in want.items():
        assert math.isclose(arrays[i], w, rel_tol=1e-5) and math.isclose(joined[i], w, rel_tol=1e-9)
    table = px.model(px.counts(rows))
    scorer = px.Arrays(table.toArrow())
    unseen = "qqq zzz the"
    assert math.isclose(scorer.log_p("en", px.grams([unseen])[0]).sum(), en.log_p(unseen), rel_tol=1e-5)
    total = sum(math.exp(scorer.log_p("en", np.array([sum(ord(c) << (16 * (3 - k)) for k, c in enumerate("the" + x))])).sum()) for x in {c for t in TEXTS for c in t} | {"\x03", "☃"})
    assert math.isclose(total, 1, rel_tol=1e-4)  # all known units and one unknown


def test_bands_reject_outliers_of_a_language(spark):
    rng = np.random.default_rng(7)
    words = ["the", "of", "and", "river", "stone", "walks", "under", "light", "slowly", "green"]
    rows = [(i, " ".join(rng.choice(words, 120)), "en") for i in range(200)]
    rows.append((900, " ".join("".join(chr(x) for x in rng.integers(33, 0x3000, 7)) for _ in range(120)), "en"))
    kept = {r.doc_id: (r.kept, r.base_failed) for r in px.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept[900] == (False, False)
    good = [k for i, k in kept.items() if i < 900 and not k[1]]
    assert all(k[0] for k in good)


def test_awkward_rows(spark):
    rows = px.rules(awkward(spark)).collect()
    assert len(rows) == 9 and all(r.base_failed and not r.kept for r in rows)
    assert px.rules(empty(spark)).count() == 0
    assert px.keep_good(awkward(spark)).columns == awkward(spark).columns
