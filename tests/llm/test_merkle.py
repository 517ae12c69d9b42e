"""Merkle manifests: the walk against whole trees, the query against its SQL and plain Python, blocks of any size, awkward rows."""

import hashlib
import zlib
from collections import defaultdict

from helpers import awkward, empty

from locusframe.llm import merkle, registry


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def whole(leaves):
    """The root of a list of leaves, and each one's path, level by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            paths[k].append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        level, at = [sha(*r) for r in runs], [i // 3 for i in at]
    return level[0], paths


def brute(rows):
    """The manifest of rows (doc_id, text, lang, source, n_chars), as a list of tuples."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    by = defaultdict(list)
    for r in rows:
        even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        own = leaf(r, r.text)
        by[r.source].append((r.doc_id, own, leaf(r, r.text.replace("\n", "")) if even and r.text is not None else own))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = whole([x[1] for x in by[s]])
    root, above = whole([trees[s][0] for s in sources]) if sources else ("", [])
    out = []
    for s, top in zip(sources, above, strict=True):
        for (doc_id, own, other), path in zip(by[s], trees[s][1], strict=True):
            path, x = path + top, other
            for place, others in path:
                x = sha(*others[:place], x, *others[place:])
            out.append((doc_id, own, trees[s][0], root, sha(*(h for _, o in path for h in o)), x, x == root))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def collected(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_walk_gives_the_paths_of_the_whole_tree():
    for n in [*range(1, 60), 80, 81, 82, 242, 243, 244, 300, 728, 729]:
        leaves = [sha(str(i)) for i in range(n)]
        root, paths = whole(leaves)
        levels = merkle.height(n)
        assert merkle.block_root(leaves, levels) == root and [list(p) for p in merkle.walk(leaves, levels)] == paths
        assert all(merkle.fold(x, p) == root and merkle.parsed(merkle.written(p)) == p for x, p in zip(leaves, paths, strict=True))


def test_stacks_hold_few_nodes_and_are_ready_in_time(monkeypatch):
    held, late = [], []
    step, finish = merkle.Stack.step, merkle.Stack.finish
    monkeypatch.setattr(merkle.Stack, "step", lambda self: (step(self), held.append(sum(map(len, self.open)) + len(self.nodes)))[0])
    monkeypatch.setattr(merkle.Stack, "finish", lambda self: (late.append(self.end - self.at if self.at > self.level and self.nodes else 0), finish(self))[1])
    list(merkle.walk([sha(str(i)) for i in range(729)], 6))
    assert max(held) <= 2 * 6 + 2 and max(late) <= 3**5


def test_query_on_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = collected(registry.queries()["op12_merkle_manifest"](spark, sf_dir))
    assert got == sorted(brute(docs.collect()), key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_query_equals_its_sql(spark, sf_dir):
    from tests.oracle import database, difference

    assert difference(registry.queries()["op12_merkle_manifest"](spark, sf_dir), database(sf_dir), registry.oracle_sql()["op12_merkle_manifest"]) is None


def test_blocks_of_any_size_give_equal_rows(spark):
    rows = [(i * 7 % 100, f"text\n{i % 90}", "en", ["big", "s1", None, "é", ""][0 if i % 3 else i % 5], i) for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(brute(docs.collect()), key=repr)
    for levels in (1, 2, 6):
        assert collected(merkle.manifest(docs, merkle.without_newlines(), levels)) == want


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    docs = docs.selectExpr("*", "1 as at", "2 as `total`", "3 as path", "4 as KEY", "5 as block", "6 as leaf")
    assert collected(merkle.manifest(docs, merkle.without_newlines())) == sorted(brute(docs.collect()), key=repr)
    assert all(r.verified and r.folded_root == r.root for r in merkle.manifest(docs).collect())
    assert merkle.manifest(empty(spark)).count() == 0
    one = merkle.manifest(docs.limit(1)).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha()
