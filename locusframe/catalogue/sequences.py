"""Scalar functions over sequences: texts stand in for proteins and DNA (see text_as_protein and text_as_dna)."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import motifs, windows
from locusframe.functions import sequence as S

from .base import DNA_SQL, PROTEIN_SQL, RESIDUES_SQL, registry, rounded, texts

QUERIES, ORACLES, query = registry()

MOTIF_A, MOTIF_C, GAP = "[FYLIV]-x-[AST]-[DN]-[AILMV]", "[FYLIVMA]-x-[DE]-D", (40, 180)


def _protein(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", S.text_as_protein(F.col("text")).alias("s"))


def _dna(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", S.text_as_dna(F.col("text")).alias("s"))


_P = f"WITH p AS (SELECT doc_id, {PROTEIN_SQL} AS s FROM documents)"
_D = f"WITH p AS (SELECT doc_id, {DNA_SQL} AS s FROM documents)"


@query("""SELECT item_id, upper(regexp_replace(replace(text, 'ß', 'SS'), '^\\s+|\\s+$', '', 'g')).regexp_replace('[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g') AS cleaned FROM benchmark""")
def seq_clean(spark, sf_dir):
    return texts(spark, sf_dir, "benchmark", "item_id").select("item_id", S.clean_protein(F.col("text")).alias("cleaned"))


@query(f"""{_P}, n AS (SELECT doc_id, s, length(replace(s, 'X', '')) AS n FROM p)
SELECT doc_id, a AS residue, round((length(s) - length(replace(s, a, ''))) / greatest(n, 1), 6) AS frequency FROM n CROSS JOIN (VALUES {RESIDUES_SQL[1:-1]}) v(a)""")
def seq_composition(spark, sf_dir):
    rows = _protein(spark, sf_dir).select("doc_id", F.explode(S.composition(F.col("s"))).alias("c"))
    return rows.select("doc_id", F.col("c.residue").alias("residue"), rounded(F.col("c.frequency")).alias("frequency"))


@query(f"""{_P}, c AS (SELECT doc_id, a, length(s) - length(replace(s, a, '')) AS k, length(replace(s, 'X', '')) AS n FROM p CROSS JOIN (VALUES {RESIDUES_SQL[1:-1]}) v(a))
SELECT doc_id, round(sum(CASE WHEN k > 0 THEN -(k / n) * log2(k / n) ELSE 0.0 END), 6) AS entropy FROM c GROUP BY doc_id""")
def seq_entropy(spark, sf_dir):
    return _protein(spark, sf_dir).select("doc_id", rounded(S.shannon_entropy(F.col("s"))).alias("entropy"))


@query(f"""{_D} SELECT doc_id, round(CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[AT]', '', 'g')) / length(s) ELSE 0.0 END, 6) AS gc FROM p""")
def seq_gc_fraction(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", rounded(S.gc_content(F.col("s"))).alias("gc"))


@query(f"""{_P} SELECT doc_id, translate(s, 'LVIMCAGSTPFYWEDNQKRH', 'LLLLCAGSSPFFFEEEEKKH') AS reduced FROM p""")
def seq_reduced_alphabet(spark, sf_dir):
    return _protein(spark, sf_dir).select("doc_id", S.reduce_alphabet(F.col("s")).alias("reduced"))


@query(f"""{_D} SELECT doc_id, reverse(translate(s, 'ACGT', 'TGCA')) AS reverse_complement FROM p""")
def seq_reverse_complement(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", S.reverse_complement(F.col("s")).alias("reverse_complement"))


_CODON = "substr('" + S.GENETIC_CODE + "', 16 * (strpos('TCAG', substr(s, 3 * i + 1, 1)) - 1) + 4 * (strpos('TCAG', substr(s, 3 * i + 2, 1)) - 1) + strpos('TCAG', substr(s, 3 * i + 3, 1)), 1)"


@query(f"""{_D}, t AS (SELECT doc_id, array_to_string(list_transform(range(0, length(s) // 3), lambda i: {_CODON}), '') AS protein FROM p)
SELECT doc_id, protein, split_part(protein, '*', 1) AS to_stop FROM t""")
def seq_translated(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", S.translate(F.col("s"), False).alias("protein"), S.translate(F.col("s")).alias("to_stop"))


_LOW = "+".join(f"CASE WHEN c{a} > 0 THEN -(c{a} / n) * log2(c{a} / n) ELSE 0 END" for a in S.AMINO)
_ROLL = ", ".join(f"sum((c = '{a}')::int) OVER w AS c{a}" for a in S.AMINO)


@query(f"""{_P}, c AS (SELECT doc_id, length(s) AS l, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS c FROM p WHERE length(s) > 0),
r AS (SELECT doc_id, l, i, sum((c <> 'X')::int) OVER w AS n, {_ROLL} FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
f AS (SELECT doc_id, avg(({_LOW} < 3.0 - 1e-9)::int) AS low FROM r WHERE i >= least(20, l) GROUP BY doc_id)
SELECT p.doc_id, round(coalesce(low, 0.0), 6) AS low_complexity FROM p LEFT JOIN f USING (doc_id)""")
def seq_low_complexity(spark, sf_dir):
    return _protein(spark, sf_dir).select("doc_id", rounded(windows.low_complexity_fraction("s")).alias("low_complexity"))


@query(f"""WITH p AS (SELECT item_id, {PROTEIN_SQL} AS s FROM benchmark),
q AS (SELECT a.item_id, a.s AS x, b.s AS y FROM p a JOIN p b ON b.item_id = a.item_id + 1),
m AS (SELECT item_id, length(x) AS lx, length(y) AS ly, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, i, 1) = substr(y, i, 1))) AS same FROM q)
SELECT item_id, greatest(lx, ly) - same AS hamming, round(same / greatest(lx, ly), 6) AS identity FROM m""")
def seq_hamming_identity(spark, sf_dir):
    p = texts(spark, sf_dir, "benchmark", "item_id").select("item_id", S.text_as_protein(F.col("text")).alias("x"))
    pairs = p.join(p.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y")), "item_id")
    return pairs.select("item_id", S.hamming(F.col("x"), F.col("y")).cast("long").alias("hamming"), rounded(S.identity(F.col("x"), F.col("y"))).alias("identity"))


@query(f"""{_P}, w AS (SELECT doc_id, unnest(range(0, length(s) - 3)) AS start, s FROM p WHERE length(s) >= 4)
SELECT doc_id, start, substr(s, start + 1, 4) AS match FROM w WHERE regexp_matches(substr(s, start + 1, 4), '^[FYLIVMA].[DE]D$')""")
def motif_matches(spark, sf_dir):
    found = motifs.matches(_protein(spark, sf_dir), "doc_id", F.col("s"), MOTIF_C)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), "match")


@query(f"""{_P}, a AS (SELECT * FROM (SELECT doc_id, unnest(range(0, length(s) - 4)) AS start, s FROM p WHERE length(s) >= 5) WHERE regexp_matches(substr(s, start + 1, 5), '^[FYLIV].[AST][DN][AILMV]$')),
c AS (SELECT * FROM (SELECT doc_id, unnest(range(0, length(s) - 3)) AS start, s FROM p WHERE length(s) >= 4) WHERE regexp_matches(substr(s, start + 1, 4), '^[FYLIVMA].[DE]D$'))
SELECT a.doc_id, a.start, count(c.start) AS n_linked FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND c.start BETWEEN a.start + 5 + {GAP[0]} AND a.start + 5 + {GAP[1]} GROUP BY 1, 2""")
def motif_range_join(spark, sf_dir):
    p = _protein(spark, sf_dir)
    found = [motifs.matches(p, "doc_id", F.col("s"), m) for m in (MOTIF_A, MOTIF_C)]
    return motifs.linked_pairs(*found, "doc_id", GAP).select("doc_id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n_linked"))


@query(f"""{_D}, b AS (SELECT doc_id, 1 AS strand, string_split(s, '') AS l, length(s) AS n FROM p UNION ALL SELECT doc_id, -1, string_split(reverse(translate(s, 'ACGT', 'TGCA')), ''), length(s) FROM p),
c AS (SELECT doc_id, strand, n, i AS pos, l[i + 1] || l[i + 2] || l[i + 3] AS codon FROM b, unnest(range(0, greatest(n - 2, 0))) u(i)),
k AS (SELECT * FROM c WHERE codon IN ('ATG', 'TAA', 'TAG', 'TGA')),
f AS (SELECT *, min(CASE WHEN codon <> 'ATG' THEN pos END) OVER (PARTITION BY doc_id, strand, pos % 3 ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM k)
SELECT doc_id, (CASE WHEN strand = 1 THEN pos ELSE n - stop - 3 END)::int AS start, (CASE WHEN strand = 1 THEN stop + 3 ELSE n - pos END)::int AS "end", strand::int AS strand, ((stop - pos) // 3)::int AS length FROM f WHERE codon = 'ATG' AND stop IS NOT NULL AND (stop - pos) // 3 >= 30""")
def open_reading_frames(spark, sf_dir):
    rows = _dna(spark, sf_dir).select("doc_id", F.explode(windows.open_reading_frames("s")).alias("o"))
    return rows.select("doc_id", "o.start", "o.end", "o.strand", "o.length")
