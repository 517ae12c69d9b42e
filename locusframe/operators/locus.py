"""Neighbourhoods of genes along contigs: windows, operons, architectures, and matches with described systems.

Genes are rows (contig_id, gene_id, start, end, strand, label, aa_length). A locus is one row an anchor gene with its
neighbours as an ordered array, gathered by one window over the contig: no self-join, and each row's arrays hold
at most twice ``each_side`` genes. What is said of a locus afterwards are expressions over those arrays.

A contig may be any share of the rows: its windows run over chunks of it. A chunk also gets the genes near its edges,
which any of its anchors can reach, so the result is that of a window over the whole contig.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_BP, EACH_SIDE, MAX_GAP, SPAN_MARGIN = 12_000, 6, 60, 500
MATCH_SCORE, EXPLAIN_SCORE = 0.85, 0.6
FAR_AWAY = 10**9
#: A chunk is this many times as long as what is added at each of its edges.
CHUNK_REACHES = 8
GENE = ("gene_id", "start", "end", "strand", "label", "aa_length")


def take_while(items: Column, ok: Column) -> Column:
    """The leading items whose entries in ok are true."""
    stop = F.array_position(ok, False)
    return F.when(stop > 0, F.slice(items, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(items)


def loci(genes: DataFrame, is_anchor: Column, window_bp: int = WINDOW_BP, each_side: int = EACH_SIDE) -> DataFrame:
    """contig_id, anchor, genes (in order), at (the anchor's place among them, from 0), span_start and span_end.

    A side ends before the first gene that lies further than window_bp from the anchor, or after each_side genes.
    """
    longest = genes.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0  # one number
    reach = window_bp + max(longest, 0) + 1
    chunk = lambda at: F.floor(at / (CHUNK_REACHES * reach))
    spread = genes.withColumn("is_anchor", is_anchor).withColumn("chunk", F.explode(F.sequence(chunk(F.col("start") - reach), chunk(F.col("start") + reach))))
    w = Window.partitionBy("contig_id", "chunk").orderBy("start", "gene_id")
    gene = F.struct(*GENE)
    near = spread.select(
        "contig_id",
        gene.alias("anchor"),
        F.reverse(F.collect_list(gene).over(w.rowsBetween(-each_side, -1))).alias("left"),
        F.collect_list(gene).over(w.rowsBetween(1, each_side)).alias("right"),
        (F.col("is_anchor") & (chunk(F.col("start")) == F.col("chunk"))).alias("is_anchor"),
    ).where("is_anchor")
    a = F.col("anchor")
    left = take_while(F.col("left"), F.transform("left", lambda g: a["start"] - g["end"] <= window_bp))
    right = take_while(F.col("right"), F.transform("right", lambda g: g["start"] - a["end"] <= window_bp))
    out = near.select("contig_id", "anchor", left.alias("left"), right.alias("right"))
    out = out.select("contig_id", "anchor", F.concat(F.reverse("left"), F.array("anchor"), "right").alias("genes"), F.size("left").alias("at"))
    return out.withColumn("span_start", F.array_min(F.col("genes.start")) - SPAN_MARGIN).withColumn("span_end", F.array_max(F.col("genes.end")) + SPAN_MARGIN)


def _sides() -> tuple[Column, Column]:
    """The anchor's neighbours to the left and right, the nearest first."""
    return F.reverse(F.slice("genes", F.lit(1), F.col("at"))), F.slice("genes", F.col("at") + 2, F.size("genes"))


def neighbours(located: DataFrame) -> DataFrame:
    """A row a gene of each locus: offset, gap to the gene before (0 for the first), same strand as the anchor, and whether all up to the anchor are."""
    left, right = _sides()
    same = lambda side: F.size(take_while(side, F.transform(side, lambda g: g["strand"] == F.col("anchor.strand"))))
    flat = located.select("contig_id", F.col("anchor.gene_id").alias("anchor_id"), F.col("anchor.strand").alias("anchor_strand"), "genes", "at", same(left).alias("run_left"), same(right).alias("run_right"))
    rows = flat.select("*", F.posexplode("genes").alias("i", "gene"))
    before = F.when(F.col("i") > 0, F.element_at("genes", F.greatest(F.col("i"), F.lit(1)))["end"])
    return rows.select(
        "contig_id",
        "anchor_id",
        F.col("gene.gene_id").alias("gene_id"),
        (F.col("i") - F.col("at")).alias("offset"),
        F.coalesce(F.col("gene.start") - before, F.lit(0)).alias("gap"),
        (F.col("gene.strand") == F.col("anchor_strand")).alias("same_strand"),
        (F.col("i") - F.col("at")).between(-F.col("run_left"), F.col("run_right")).alias("co_directional_run"),
    )


def with_operon(located: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Adds operon: the unbroken run of the anchor's strand around it with gaps of at most max_gap."""
    left, right = _sides()
    nearer = lambda side: F.concat(F.array("anchor"), side)  # noqa: E731  the gene each one is compared with; one longer
    ok_left = F.zip_with(left, F.slice(nearer(left), F.lit(1), F.size(left)), lambda g, n: (g["strand"] == F.col("anchor.strand")) & (n["start"] - g["end"] <= max_gap))
    ok_right = F.zip_with(right, F.slice(nearer(right), F.lit(1), F.size(right)), lambda g, n: (g["strand"] == F.col("anchor.strand")) & (g["start"] - n["end"] <= max_gap))
    return located.withColumn("operon", F.concat(F.reverse(take_while(left, ok_left)), F.array("anchor"), take_while(right, ok_right)))


def islands(genes: DataFrame, max_gap: int = MAX_GAP, chunk_bp: int = 1_000_000) -> DataFrame:
    """genes with island, the number from 0 of its unbroken same-strand run on its contig (all operons at once).

    Breaks are counted within chunks of a contig, then carried over the chunks: no task gets a whole contig's genes.
    """
    order = ["start", "gene_id"]
    cut = genes.withColumn("chunk", F.floor(F.col("start") / chunk_bp))
    inner = Window.partitionBy("contig_id", "chunk").orderBy(*order)
    before = lambda c: F.lag(c).over(inner)
    breaks = (before("strand") != F.col("strand")) | (F.col("start") - before("end") > max_gap)
    marked = cut.withColumn("_break", F.coalesce(breaks.cast("int"), F.lit(0)))
    edge = F.struct(*order, "end", "strand")
    chunks = marked.groupBy("contig_id", "chunk").agg(F.min(edge).alias("head"), F.max(edge).alias("tail"), F.sum("_break").alias("inner_breaks"))
    over = Window.partitionBy("contig_id").orderBy("chunk")
    tail = F.lag("tail").over(over)
    joint = F.coalesce(((tail["strand"] != F.col("head.strand")) | (F.col("head.start") - tail["end"] > max_gap)).cast("int"), F.lit(0))
    chunks = chunks.withColumn("joint", joint)
    carried = F.sum(F.col("inner_breaks") + F.col("joint")).over(over) - F.col("inner_breaks")
    chunks = chunks.select("contig_id", "chunk", carried.alias("carried"))
    running = F.sum("_break").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_run", running).join(chunks, ["contig_id", "chunk"]).withColumn("island", F.col("carried") + F.col("_run")).drop("_break", "_run", "carried", "chunk")


ARRAYS = "array<struct<start:bigint,end:bigint,copy_number:int,repeat_length:int,class:string,quality:double>>"
#: Base pairs of a bin by which loci and arrays meet.
ARRAY_BIN = 1 << 16


def with_arrays(located: DataFrame, arrays: DataFrame) -> DataFrame:
    """Adds arrays: the repeat arrays (contig_id, start, end, copy_number, repeat_length, class, and quality where it is known) that overlap the locus' span, by start.

    A range join by bins of a contig, so that a contig may be any share of the rows; a pair counts in the first bin that both reach.
    """
    bins = lambda a, b: F.sequence(F.floor(a / ARRAY_BIN), F.floor((b - 1) / ARRAY_BIN))
    of_loci = located.select("contig_id", F.col("anchor.gene_id").alias("anchor_id"), "span_start", "span_end").withColumn("bin", F.explode(bins(F.col("span_start"), F.col("span_end"))))
    of_arrays = arrays.withColumn("bin", F.explode(bins(F.col("start"), F.col("end"))))
    if "quality" not in arrays.columns:
        of_arrays = of_arrays.withColumn("quality", F.lit(None).cast("double"))
    overlap = (F.col("start") < F.col("span_end")) & (F.col("span_start") < F.col("end"))
    inside = of_loci.join(of_arrays, ["contig_id", "bin"]).where(overlap & (F.col("bin") == F.floor(F.greatest("start", "span_start") / ARRAY_BIN)))
    found = inside.groupBy("contig_id", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "copy_number", "repeat_length", "class", "quality"))).alias("arrays"))
    joined = located.drop("arrays").withColumn("anchor_id", F.col("anchor.gene_id")).join(found, ["contig_id", "anchor_id"], "left").drop("anchor_id")
    return joined.withColumn("arrays", F.coalesce("arrays", F.array().cast(ARRAYS)))


def without_arrays(located: DataFrame) -> DataFrame:
    return located.withColumn("arrays", F.array().cast(ARRAYS))


def architecture(genes: Column, arrays: Column, anchor: Column, detail: str = "full") -> Column:
    """``label(+)-array[...]-label(-)`` in order, turned so that the anchor is forward; detail "class" names an array's class and folds equal neighbours."""
    turned = anchor["strand"] == -1
    sign = lambda g: F.when(g["strand"] * F.when(turned, -1).otherwise(1) > 0, "(+)").otherwise("(-)")
    item = lambda start, rank, text: F.struct(start.alias("start"), F.lit(rank).alias("rank"), text.alias("text"))
    of_genes = F.transform(genes, lambda g: item(g["start"], 0, F.concat(g["label"], sign(g))))
    inner = (lambda a: a["class"]) if detail == "class" else (lambda a: F.concat_ws("x", a["copy_number"].cast("string"), a["repeat_length"].cast("string")))
    of_arrays = F.transform(arrays, lambda a: item(a["start"], 1, F.concat(F.lit("array["), inner(a), F.lit("]"))))
    ordered = F.array_sort(F.concat(of_genes, of_arrays))
    tokens = F.transform(F.when(turned, F.reverse(ordered)).otherwise(ordered), lambda x: x["text"])
    if detail == "class":
        tokens = F.filter(tokens, lambda t, i: ~(F.startswith(t, F.lit("array[")) & (i > 0) & (F.element_at(tokens, F.greatest(i, F.lit(1))) == t)))
    return F.array_join(tokens, "-")


def array_distance(operon: Column, arrays: Column) -> Column:
    """Base pairs between an operon and its nearest array; 0 if they overlap, FAR_AWAY without one."""
    lo, hi = F.array_min(F.transform(operon, lambda g: g["start"])), F.array_max(F.transform(operon, lambda g: g["end"]))
    return F.coalesce(F.array_min(F.transform(arrays, lambda a: F.greatest(a["start"] - hi, lo - a["end"], F.lit(0)))), F.lit(FAR_AWAY))


def mean_intergenic_gap(located: DataFrame) -> DataFrame:
    """One row: the mean gap between anchors and their direct neighbours, overlaps as 0."""
    left, right = _sides()
    gaps = F.concat(
        F.transform(F.slice(left, 1, 1), lambda g: F.greatest(F.lit(0), F.col("anchor.start") - g["end"])), F.transform(F.slice(right, 1, 1), lambda g: F.greatest(F.lit(0), g["start"] - F.col("anchor.end")))
    )
    return located.select(F.explode(gaps).alias("gap")).agg(F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"), F.count("*").alias("n"))


def conservation(located: DataFrame, by: list[str] | None = None) -> DataFrame:
    """label and rate: the share of loci whose operon, besides the anchor, has the label; ``__array__`` for arrays."""
    by = by or []
    labels = F.array_distinct(F.concat(F.transform(F.filter("operon", lambda g: g["gene_id"] != F.col("anchor.gene_id")), lambda g: g["label"]), F.when(F.size("arrays") > 0, F.array(F.lit("__array__"))).otherwise(F.array().cast("array<string>"))))
    seen = located.select(*by, F.explode(labels).alias("label")).groupBy(*by, "label").agg(F.count("*").alias("n_loci"))
    total = located.groupBy(*by).agg(F.count("*").alias("total"))
    joined = seen.join(total, by) if by else seen.crossJoin(F.broadcast(total))  # one row
    return joined.select(*by, "label", "n_loci", (F.col("n_loci") / F.col("total")).alias("rate"))


# ---- described systems


@dataclass(frozen=True)
class System:
    system_id: str
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    requires_array: bool = False
    forbids_array: bool = False
    array_repeat_range: tuple[int, int] | None = None
    anchor_aa: tuple[int, int] | None = None
    notes: dict = field(default_factory=dict, compare=False)


def match(system: System) -> Column:
    """A struct (system_id, score, satisfied, unsatisfied, violations, explained) of a locus with operon and arrays."""
    labels = F.transform("operon", lambda g: g["label"])
    around = F.transform("genes", lambda g: g["label"])
    required = F.array(*map(F.lit, system.required)) if system.required else F.array().cast("array<string>")
    inside = F.filter(required, lambda r: F.array_contains(labels, r))
    outside = F.filter(required, lambda r: ~F.array_contains(labels, r) & F.array_contains(around, r))
    missing = F.filter(required, lambda r: ~F.array_contains(around, r) & ~F.array_contains(labels, r))
    has_array, n = F.size("arrays") > 0, F.col("anchor.aa_length")
    found = [F.when(F.array_contains(labels, bad), F.lit(f"unexpected {bad}")) for bad in system.forbidden]
    if system.requires_array:
        found.append(F.when(~has_array, F.lit("no repeat array")))
    if system.forbids_array:
        found.append(F.when(has_array, F.lit("unexpected repeat array")))
    if system.array_repeat_range:
        lo, hi = system.array_repeat_range
        found.append(F.when(has_array & ~F.exists("arrays", lambda a: a["repeat_length"].between(lo, hi)), F.lit(f"array repeat length outside {lo}-{hi}")))
    if system.anchor_aa:
        lo, hi = system.anchor_aa
        found.append(F.when((n > 0) & ~n.between(lo * 0.6, hi * 1.6), F.concat(F.lit("anchor "), n.cast("string"), F.lit(f" aa far from {lo}-{hi}"))))
    violations = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    described = F.array(*map(F.lit, dict.fromkeys(system.required + system.optional)))
    extra = F.transform(F.filter("operon", lambda g: ~F.array_contains(described, g["label"]) & (g["label"] != F.col("anchor.label"))), lambda g: F.concat(F.lit("gene:"), g["label"]))
    if not system.requires_array:
        extra = F.concat(extra, F.transform("arrays", lambda a: F.concat(F.lit("array:"), a["copy_number"].cast("string"), F.lit("x"), a["repeat_length"].cast("string"), F.lit("bp"))))
    score = F.least(F.lit(1.0), (F.size(inside) + 0.5 * F.size(outside)) / float(len(system.required) or 1))
    return F.struct(
        F.lit(system.system_id).alias("system_id"), F.lit(system.name).alias("name"), score.alias("score"), F.concat(inside, F.transform(outside, lambda r: F.concat(r, F.lit("(outside operon)")))).alias("satisfied"),
        missing.alias("unsatisfied"), violations.alias("violations"), extra.alias("unexplained"),
    )


def with_matches(located: DataFrame, catalogue: list[System]) -> DataFrame:
    """Adds matches, a struct a system in catalogue order. The catalogue is part of the expression: nothing is joined."""
    return located.withColumn("matches", F.array(*[match(s) for s in catalogue]))


def with_novelty(matched: DataFrame) -> DataFrame:
    """Adds best (a match), novelty, unexplained and rationale.

    Novelty is one minus the best score without violations. Where the best match scores EXPLAIN_SCORE or more, parts that
    its system does not have keep novelty at 0.35 and a tenth for each, of three at most. Ties go to fewer violations, then to catalogue order.
    """
    ranked = F.array_sort(F.transform("matches", lambda m, i: F.struct((-m["score"]).alias("a"), F.size(m["violations"]).alias("b"), i.alias("c"), m.alias("m"))), lambda x, y: F.when(_key(x) < _key(y), -1).when(_key(x) > _key(y), 1).otherwise(0))
    out = matched.withColumn("best", ranked[0]["m"])
    clean = F.coalesce(F.array_max(F.transform(F.filter("matches", lambda m: F.size(m["violations"]) == 0), lambda m: m["score"])), F.lit(0.0))
    out = out.withColumn("effective", clean).withColumn("unexplained", F.when(F.col("best.score") >= EXPLAIN_SCORE, F.col("best.unexplained")).otherwise(F.array().cast("array<string>")))
    n = F.size("unexplained")
    floor = F.when(n > 0, 0.35 + 0.1 * F.least(n, F.lit(3))).otherwise(0.0)
    out = out.withColumn("novelty", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(1 - F.col("effective"), floor))))
    why = (
        F.when((F.col("effective") >= MATCH_SCORE) & (n == 0), F.concat(F.lit("explained by "), F.col("best.name")))
        .when(F.col("effective") >= MATCH_SCORE, F.concat(F.lit("fits "), F.col("best.name"), F.lit(" besides "), F.array_join("unexplained", ", ")))
        .when(F.col("best.score") >= EXPLAIN_SCORE, F.concat(F.lit("nearest is "), F.col("best.name"), F.lit(", but: "), F.array_join(F.concat("best.unsatisfied", "best.violations"), ", ")))
        .otherwise(F.concat(F.lit("nothing fits; nearest is "), F.col("best.name")))
    )
    return out.withColumn("rationale", why)


def _key(x: Column) -> Column:
    return F.struct(x["a"], x["b"], x["c"])


def is_match(m: Column) -> Column:
    return (m["score"] >= MATCH_SCORE) & (F.size(m["violations"]) == 0)
