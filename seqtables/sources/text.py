"""Line-oriented formats: FASTA, annotation tables, cluster tables and similarity hits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.functions.parsing import describe, genome_id_of, parse_none, subject_name
from seqtables.operators.ordered import dense_ids

# Column names of the tabular formats.
HIT_COLUMNS = (
    ("query_id", "string"),
    ("subject_id", "string"),
    ("sequence_identity", "double"),
    ("alignment_length", "long"),
    ("mismatch", "long"),
    ("num_gap_openings", "long"),
    ("query_alignment_start", "long"),
    ("query_alignment_end", "long"),
    ("subject_alignment_start", "long"),
    ("subject_alignment_end", "long"),
    ("e_value", "double"),
    ("bit_score", "double"),
    ("query_coverage_per_subject", "double"),
    ("query_coverage_per_pair", "double"),
    ("query_sequence_length", "long"),
    ("subject_sequence_length", "long"),
)
ANNOTATION_COLUMNS = (
    ("meets_threshold", "string"),
    ("id", "string"),
    ("ko", "string"),
    ("threshold", "double"),
    ("score", "double"),
    ("e_value", "double"),
    ("definition", "string"),
)
SCAN_COLUMNS = ("id", "ko", "threshold", "score", "e_value", "ko_definition")
WRAP = 60


def _schema(columns: Sequence[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns)


def parse_fasta_records(records: DataFrame, parser: Callable[[Column], Column] = parse_none) -> DataFrame:
    """Records (value) of FASTA text to (id, parsed header fields, seq). ``*`` is removed everywhere."""
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    header = F.substring_index(text, "\n", 1)
    name = F.regexp_extract(header, "^\\s*(\\S+)", 1)
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n"), F.length(text))).otherwise("")
    rows = records.select("*", header.alias("__header"), name.alias("id"), body.alias("__body")).where("id != ''")
    description = F.trim(F.replace("__header", F.col("id"), F.lit("")))
    extra = [c for c in records.columns if c != "value"]
    seq = F.regexp_replace("__body", "[\\s*]", "").alias("seq")
    fields = parser(description)
    if rows.select(fields.alias("f")).schema["f"].dataType.typeName() != "struct":
        return rows.select(*extra, "id", fields.alias("fields"), seq)
    # One struct per row through inline: the header is parsed once for all its fields.
    return rows.select(*extra, "id", F.inline(F.array(fields)), seq)


def read_fasta(spark: SparkSession, path: str | list[str], parser: Callable[[Column], Column] = parse_none) -> DataFrame:
    """FASTA files, one row per record, files split between records. Adds genome_id from the path."""
    records = spark.read.option("lineSep", "\n>").text(path).select("value", genome_id_of(F.col("_metadata.file_path")).alias("genome_id"))
    return parse_fasta_records(records, parser)


def fasta_records(df: DataFrame, add_description: bool = True) -> DataFrame:
    """Table (id, value): each row as one FASTA record, sequence lines wrapped."""
    name = F.col("id").cast("string")
    about = describe(df.dtypes) if add_description else F.lit("")
    header = F.concat(F.lit(">"), name, F.when(about == "", "").otherwise(F.concat(F.lit(" "), about)))
    wrapped = F.regexp_replace("seq", f"(.{{{WRAP}}})(?=.)", "$1\n")
    return df.select("id", F.concat(header, F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, add_description: bool = True, mode: str = "error") -> None:
    """Write rows (id, seq, ..) as FASTA text files."""
    fasta_records(df, add_description).select("value").write.mode(mode).text(path)


def parse_scan_lines(lines: DataFrame, meets_threshold: bool = True) -> DataFrame:
    """Lines (value) of a profile scan: a leading ``*`` marks hits over their threshold."""
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    marked = F.col("value").startswith("*")
    parts = F.split(F.trim(F.regexp_replace("value", "^([^*]*)\\*", "$1")), "\\s+", 6)
    part = lambda i: F.get(parts, F.lit(i))
    table = rows.select(
        marked.alias("meets_threshold"),
        part(0).alias("id"),
        part(1).alias("ko"),
        part(2).try_cast("double").alias("threshold"),
        part(3).try_cast("double").alias("score"),
        part(4).try_cast("double").alias("e_value"),
        F.regexp_replace(F.coalesce(part(5), F.lit("")), "\\s+", " ").alias("ko_definition"),
    )
    return table.where("meets_threshold") if meets_threshold else table


def read_annotation_scan(spark: SparkSession, path: str | list[str], meets_threshold: bool = True) -> DataFrame:
    """Profile-scan text files; by default only hits over their threshold."""
    return parse_scan_lines(spark.read.text(path), meets_threshold)


def select_annotations(df: DataFrame, kos: Sequence[str] | None = None) -> DataFrame:
    """Annotations of the wanted orthologs with ``meets_threshold`` as a flag."""
    wanted = df if kos is None else df.where(F.col("ko").isin(*kos))
    return wanted.withColumn("meets_threshold", F.col("meets_threshold").isNotNull())


def read_annotation_tab(spark: SparkSession, path: str | list[str], kos: Sequence[str] | None = None) -> DataFrame:
    """Tab-separated annotations with ``#`` comments. Adds genome_id from the path."""
    schema = _schema(ANNOTATION_COLUMNS)
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schema)
    return select_annotations(rows.select("*", genome_id_of(F.col("_metadata.file_path")).alias("genome_id")), kos)


def number_clusters(pairs: DataFrame) -> DataFrame:
    """Add a dense ``mmseqs_cluster`` number per representative, null without one."""
    return pairs.join(dense_ids(pairs, "mmseqs_representative", "mmseqs_cluster"), "mmseqs_representative", "left")


def read_clusters(spark: SparkSession, path: str | list[str], reps_only: bool = False) -> DataFrame:
    """Cluster tables (representative, member); ``reps_only`` keeps one row per cluster."""
    from seqtables.operators.dedupe import cluster_reps

    pairs = number_clusters(spark.read.csv(path, sep="\t", schema="mmseqs_representative string, id string"))
    return cluster_reps(pairs) if reps_only else pairs


def read_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tabular similarity hits; ``id`` is the query, subjects lose their ``sp|..|`` tag."""
    rows = spark.read.csv(path, sep="\t", schema=_schema(HIT_COLUMNS))
    return rows.select(F.col("query_id").alias("id"), *[n for n, _ in HIT_COLUMNS]).withColumn(
        "subject_id", subject_name(F.col("subject_id"))
    )
