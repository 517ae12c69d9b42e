"""Text sources: FASTA files, feature tables, labels and literature.

A FASTA or feature-table file is read as records by a line separator, so that large files are split between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = 60
# Words for the two labels.
LABELS = {"promote": ("promote", "promoted", "tested", "worth_testing", "true", "yes"), "set_aside": ("set_aside", "eliminate", "eliminated", "false", "no")}


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value, file, at (the record's order) and is_first of its file."""
    rows = spark.read.option("lineSep", separator).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = rows.groupBy("file").agg(F.min("at").alias("first"))
    return rows.join(first, "file").select("value", "file", "at", (F.col("at") == F.col("first")).alias("is_first"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id (a header's first word), description and sequence of FASTA files. What stands before a file's first header is left out; of records with one id in a file the last counts."""
    rows = _records(spark, path, "\n>").where(~F.col("is_first") | F.startswith("value", F.lit(">")))
    body = F.when(F.col("is_first"), F.expr("substr(value, 2)")).otherwise(F.col("value"))
    body = F.regexp_replace(body, "\r", "")
    head = F.substring_index(body, "\n", 1)
    text = F.when(F.contains("b", F.lit("\n")), F.regexp_replace(F.expr("substr(b, length(h) + 1)"), r"\s", "")).otherwise("")
    named = rows.select(body.alias("b"), head.alias("h"), "file", "at").select("file", "at", F.regexp_extract("h", r"^(\S*)", 1).alias("seq_id"), F.trim(F.regexp_replace("h", r"^\S*", "")).alias("description"), text.alias("sequence"))
    last = named.groupBy("file", "seq_id").agg(F.max_by(F.struct("description", "sequence"), "at").alias("x"))
    return last.select("seq_id", "x.description", "x.sequence")


def fasta_text(seq_id: Column, sequence: Column, line: int = LINE) -> Column:
    """A FASTA record, the sequence in lines of ``line``."""
    return F.concat(F.lit(">"), seq_id, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{line}}})(?=.)", "$1\n"))


def write_fasta(sequences: DataFrame, path: str, line: int = LINE) -> None:
    """seq_id and sequence as FASTA files."""
    sequences.select(fasta_text(F.col("seq_id"), F.col("sequence"), line).alias("value")).write.text(path)


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Coding features of feature tables: contig_id, start (from 0), end, strand, product and protein_id.

    A contig's lines follow its ``>Feature`` line. A line of three fields with ``CDS`` begins a feature, the lines of a
    qualifier and its value after it are of that feature; a start beyond the end is the other strand.
    """
    records = _records(spark, path, "\n>").where(~F.col("is_first") | F.startswith("value", F.lit(">")))
    lines = records.select("file", "at", F.posexplode(F.split(F.regexp_replace("value", "^>|\r", ""), "\n")).alias("line", "text"))
    parts = F.split("text", "\t")
    get = lambda i: F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    number = lambda c: F.regexp_replace(c, "[<>^]", "").try_cast("long")
    contig = F.regexp_extract(F.first("text").over(Window.partitionBy("file", "at").orderBy("line")), r"Feature\s+(\S+)", 1)
    fields = lines.select("file", "at", "line", contig.alias("contig_id"), number(get(0)).alias("a"), number(get(1)).alias("b"), get(2).alias("kind"), get(3).alias("key"), get(4).alias("value"))
    begins = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("kind") != "")
    within = Window.partitionBy("file", "at").orderBy("line")
    features = fields.withColumn("feature", F.last(F.when(begins, F.col("line")), ignorenulls=True).over(within))
    of = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line")))
    found = features.where("feature is not null").groupBy("file", "at", "feature", "contig_id").agg(
        F.max(F.when(begins, F.col("kind"))).alias("kind"), F.max(F.when(begins, F.col("a"))).alias("a"), F.max(F.when(begins, F.col("b"))).alias("b"), of("product").alias("product"), of("protein_id").alias("protein_id")
    )
    cds = found.where("kind = 'CDS'")
    return cds.select("contig_id", (F.least("a", "b") - 1).alias("start"), F.greatest("a", "b").alias("end"), F.when(F.col("a") > F.col("b"), -1).otherwise(1).alias("strand"), F.coalesce("product", F.lit("")).alias("product"), F.coalesce("protein_id", F.lit("")).alias("protein_id"))


def labels(given: DataFrame) -> DataFrame:
    """candidate_id and label of given (candidate_id, label) in any of the words of LABELS; others are left out."""
    word = F.lower(F.trim("label"))
    known = F.coalesce(*[F.when(word.isin(*words), F.lit(name)) for name, words in LABELS.items()])
    return given.select("candidate_id", known.alias("label")).where("label is not null")


def literature(papers: DataFrame, question: str, limit: int = 10) -> DataFrame:
    """Papers (paper_id, title, claims, observable) by how many words of over two letters of the question they hold; those without any come last."""
    terms = [t for t in dict.fromkeys(question.lower().split()) if len(t) > 2]
    blob = F.lower(F.concat_ws(" ", "title", "claims", "observable"))
    score = sum((F.contains(blob, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return papers.withColumn("score", score).orderBy(F.desc("score"), "paper_id").limit(limit)
