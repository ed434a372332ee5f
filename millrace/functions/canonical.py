"""Order-canonical SHA-256 fingerprints (A7): each field is its byte length, four bytes big-endian, and its UTF-8 bytes.

Fields and records become hex strings, so that records are joined and hashed by built-in functions. ``fingerprint`` gathers
one group's records, as a manifest of bounded size needs; ``bulk_fingerprint`` works for tables of any size: it
hashes records in ranges, and the ranges' digests in order. The two give different values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(c: Column | str) -> Column:
    """A field as hex; a Python string is a literal. A null gives null, which no record takes: what may be null belongs in ``nullable``."""
    c = F.lit(c) if isinstance(c, str) else c
    return F.concat(F.lpad(F.hex(F.octet_length(c)), 8, "0"), F.hex(F.encode(c, "UTF-8")))


def _whole(hex_text: Column) -> Column:
    """What isn't null; a null is an error."""
    return F.when(hex_text.isNotNull(), hex_text).otherwise(F.raise_error(F.lit("null in a field that may not be null")))


def nullable(marker: str, c: Column) -> Column:
    """A marker, and absent or present with the value."""
    return F.concat(field(marker), F.when(c.isNull(), field("absent")).otherwise(F.concat(field("present"), F.coalesce(field(c), F.lit("")))))


def boolean(marker: str, c: Column) -> Column:
    """A marker, and true or false; a null is an error."""
    return F.concat(field(marker), _whole(F.when(c, field("true")).when(~c, field("false"))))


def record(*parts: Column) -> Column:
    """Fields in order, none of them null."""
    return _whole(F.concat(*parts))


def digest(hex_text: Column) -> Column:
    """The SHA-256 of hex-coded bytes, as lower-case hex."""
    return F.sha2(F.unhex(hex_text), 256)


def utf16(c: Column) -> Column:
    """A sort key that orders strings by UTF-16 code units."""
    return F.encode(c, "UTF-16BE")


def ordered_records(order: list[Column], body: Column) -> Column:
    """Aggregate: all records' hex, in the order of the keys (nulls first)."""
    keyed = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(order)), _whole(body).alias("body"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(keyed)), lambda r: r["body"]), "")


def fingerprint(df: DataFrame, header: Column, order: list[Column], body: Column, by: list[str] | None = None) -> DataFrame:
    """The fingerprint of each group: header, count of records, records in order. Groups are bounded, as manifests are."""
    grouped = df.groupBy(*(by or [])).agg(ordered_records(order, body).alias("records"), F.count("*").alias("n"))
    return grouped.select(*(by or []), digest(F.concat(header, field(F.col("n").cast("string")), "records")).alias("fingerprint"), F.col("n").alias("record_count"))


def bulk_fingerprint(df: DataFrame, key: str, body: Column, buckets: int = 4096) -> DataFrame:
    """A fingerprint of a table of any size: the digest of the digests of its distinct rows' hash buckets.

    A row is its key and body, either of which may be null; repeats are counted before a bucket is listed. The number of
    buckets is part of the value.
    """
    rows = df.select(digest(F.concat(nullable("key", F.col(key).cast("string")), F.coalesce(F.concat(field("present"), body), field("absent")))).alias("d"))
    parts = rows.groupBy("d").agg(F.count("*").alias("n")).withColumn("b", F.pmod(F.xxhash64("d"), F.lit(buckets)))
    each = parts.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("d", F.lit(":"), F.col("n").cast("string")))), ","), 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda r: r["d"]), ""), 256).alias("fingerprint"))
