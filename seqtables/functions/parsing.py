"""Expressions that take identifiers, headers and annotation text apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqtables.functions.rows import let

# Header fields, taxonomy levels and identifier patterns.
PRODIGAL_FIELDS = (
    ("start", "long", "([\\d]+)"),
    ("stop", "long", " # ([\\d]+)"),
    ("strand", "int", " # ([-1]+)"),
    ("ID", "string", " # ID=([^;]+)"),
    ("partial", "string", ";partial=([^;]+)"),
    ("start_type", "string", ";start_type=([^;]+)"),
    ("rbs_motif", "string", ";rbs_motif=([^;]+)"),
    ("rbs_spacer", "string", ";rbs_spacer=([^;]+)"),
    ("gc_content", "double", ";gc_cont=([.\\w]+)"),
)
TAXONOMY_LEVELS = ("domain", "phylum", "class", "order", "family", "genus", "species")
GENOME_ID_PATTERN = "GC[AF]_\\d{9}\\.\\d"
SUBJECT_TAG_PATTERN = "^sp\\|([A-Za-z0-9]+)\\|"


def parse_prodigal(description: Column) -> Column:
    """Struct of the nine gene-caller header fields; null fields where the header does not fit.

    One pattern match per row lines the groups up, then a plain split hands them out.
    """
    pattern = "(?s)^.*?# " + "".join(group for _, _, group in PRODIGAL_FIELDS) + ".*$"
    groups = "\t".join(f"${i + 1}" for i in range(len(PRODIGAL_FIELDS)))
    parts = F.split(F.regexp_replace(description, pattern, groups), "\t")

    def fields(parts: Column) -> Column:
        fits = F.size(parts) == len(PRODIGAL_FIELDS)
        return F.struct(
            *[
                F.when(fits, F.get(parts, F.lit(i))).try_cast(kind).alias(name)
                for i, (name, kind, _) in enumerate(PRODIGAL_FIELDS)
            ]
        )

    return let(parts, fields)


def parse_kv(description: Column) -> Column:
    """Map of a ``key=value;key=value`` header."""
    return F.str_to_map(description, F.lit(";"), F.lit("="))


def parse_none(description: Column) -> Column:
    """Struct that passes the header through unread."""
    return F.struct(description.alias("description"))


def describe(df_types: list[tuple[str, str]], skip: tuple[str, ...] = ("id", "seq")) -> Column:
    """``k=v;k=v`` over the string columns that are not null, '=' removed, values trimmed."""
    fields = [
        F.concat(F.lit(f"{name}="), F.trim(F.replace(F.col(f"`{name}`"), F.lit("="), F.lit(""))))
        for name, kind in df_types
        if kind == "string" and name not in skip
    ]
    return F.concat_ws(";", *fields) if fields else F.lit("")


def parse_coordinate(text: Column) -> Column:
    """Struct (strand, start, stop, partial) of a flat-file location."""
    start = F.regexp_extract(text, "([<>]?\\d+)\\.\\.([<>]?\\d+)", 1)
    stop = F.regexp_extract(text, "([<>]?\\d+)\\.\\.([<>]?\\d+)", 2)
    flag = lambda side, sign: F.when(side.contains(sign), "1").otherwise("0")
    return F.struct(
        F.when(text.contains("complement"), -1).otherwise(1).alias("strand"),
        F.translate(start, "<>", "").try_cast("long").alias("start"),
        F.translate(stop, "<>", "").try_cast("long").alias("stop"),
        F.concat(flag(start, "<"), flag(stop, ">")).alias("partial"),
    )


def parse_note(note: Column) -> Column:
    """Struct of the three flags of a note; null flags without a note."""
    return F.struct(
        note.contains("frameshifted").alias("frameshifted"),
        note.contains("internal stop").alias("internal_stop"),
        note.contains("incomplete").alias("incomplete"),
    )


def genome_id_of(text: Column) -> Column:
    """Genome accession inside a path or header, null when there is none."""
    return F.nullif(F.regexp_extract(text, GENOME_ID_PATTERN, 0), F.lit(""))


def strip_source_prefix(accession: Column) -> Column:
    """Accession without its GB_ or RS_ mark."""
    return F.regexp_replace(accession, "GB_|RS_", "")


def taxonomy_level(text: Column, level: str) -> Column:
    """One level of a ``d__..;p__..`` string."""
    return F.regexp_extract(text, f"{level[0]}__([^;]*)", 1)


def subject_name(subject: Column) -> Column:
    """Subject id without a ``sp|id|`` tag."""
    return F.coalesce(F.nullif(F.regexp_extract(subject, SUBJECT_TAG_PATTERN, 1), F.lit("")), subject)


def contig_before_dot(gene_id: Column) -> Column:
    """Contig id: everything before the first dot."""
    return F.substring_index(gene_id, ".", 1)


def contig_before_number(gene_id: Column) -> Column:
    """Contig id: everything before the last underscore."""
    return F.regexp_replace(gene_id, "_[^_]*$", "")


def code_name(species: Column) -> Column:
    """Four letters: the first of the genus, three of the species word."""
    words = F.split(F.trim(species), "\\s+")
    return F.lower(F.concat(F.left(words[0], F.lit(1)), F.left(F.element_at(words, -1), F.lit(3))))


def short_name(species: Column) -> Column:
    """Genus initial and species word."""
    words = F.split(F.trim(species), "\\s+")
    return F.concat(F.left(words[0], F.lit(1)), F.lit(". "), F.element_at(words, -1))


def numeric_or_text(text: Column) -> Column:
    """Struct (as_long, as_double, as_text): the narrowest reading of a header value is filled."""
    whole = text.try_cast("long")
    real = F.when(whole.isNull(), text.try_cast("double"))
    return F.struct(
        whole.alias("as_long"),
        real.alias("as_double"),
        F.when(whole.isNull() & real.isNull(), text).alias("as_text"),
    )


def none_to_number(text: Column, kind: str) -> Column:
    """Number of a text column in which 'none' stands for -1."""
    return F.when(text == "none", F.lit(-1).cast(kind)).otherwise(text.try_cast(kind))
