"""Field and segment catalogs: flags, capabilities and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM_VECTORS, NO_NORMS, PAYLOADS = 1, 2, 4  #: bits of a field's flags
DOCS, FREQS, POSITIONS, OFFSETS = 1, 2, 3, 4  #: what a field's postings hold, each with all before


def has_bit(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask)) != 0


def flags(fields: DataFrame) -> DataFrame:
    """The fields with their flags and what may be asked of them, from ``field_bits`` and ``index_option_bits``."""
    bits, opts = F.col("field_bits"), F.col("index_option_bits")
    return fields.select(
        "field_number", "field_name", has_bit(bits, TERM_VECTORS).alias("store_term_vec"), has_bit(bits, NO_NORMS).alias("omit_norm"), has_bit(bits, PAYLOADS).alias("store_payload"),
        (opts >= FREQS).alias("has_freqs"), (opts >= POSITIONS).alias("has_prox"), (opts >= OFFSETS).alias("has_offsets"), ((opts > 0) & ~has_bit(bits, NO_NORMS)).alias("has_norms"),
    )


def capabilities(fields: DataFrame) -> DataFrame:
    """One row: whether any field has positions, offsets or payloads."""
    return fields.agg(F.bool_or("has_prox").alias("has_prox"), F.bool_or("has_offsets").alias("has_offsets"), F.bool_or("store_payload").alias("has_payloads"))


def check_norms(norms: DataFrame, fields: DataFrame) -> DataFrame:
    """``norms`` with the names of their fields; a norm of a field that is not indexed or omits norms is an error."""
    f = F.broadcast(flags(fields).select("field_number", "field_name", "has_norms"))  # a row for each field
    rows = norms.join(f, "field_number", "left")
    ok = F.when(F.coalesce("has_norms", F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.format_string("field %d has no norms", "field_number")).cast("boolean"))
    return rows.where(ok).drop("has_norms")


def segments(docs: DataFrame, segment: str, doc_id: str, live: str) -> DataFrame:
    """``(segment, segment_size, labelled, del_count, doc_base)``: documents, live and not, and the first id."""
    n = F.sum(F.col(live).cast("long"))
    return docs.groupBy(segment).agg(F.count(F.lit(1)).alias("segment_size"), n.alias("labelled"), (F.count(F.lit(1)) - n).alias("del_count"), F.min(doc_id).alias("doc_base"))
