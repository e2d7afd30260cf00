"""Sizes, canonical headers, hashes and identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a frame besides its variable parts, of a header besides key and value, of a page and its entries.
FRAME_FIXED, FRAME_CRC, HEADER_FIXED = 112, 4, 8
EXTENTS_A_PAGE, NAMES_A_BLOCK = 743, 256
DOMAIN = "reclog/request/1"


def frame_len(request_id: Column, producer: Column, headers: Column, payload: Column) -> Column:
    """Bytes of a record: fixed part, request id, producer, each header, payload and checksum."""
    sizes = F.aggregate(F.map_entries(headers), F.lit(0).cast("long"), lambda a, x: a + HEADER_FIXED + F.octet_length(x["key"]) + F.octet_length(x["value"]))
    return (F.lit(FRAME_FIXED + FRAME_CRC).cast("long") + F.octet_length(request_id) + F.octet_length(producer) + sizes + F.octet_length(payload)).cast("long")


def canonical(headers: Column) -> Column:
    """Headers as entries sorted by key, the form that is compared and hashed."""
    return F.array_sort(F.map_entries(headers))


def le64(n: Column) -> Column:
    """A number as eight little-endian bytes."""
    return F.unhex(F.regexp_replace(F.lpad(F.hex(n.cast("long")), 16, "0"), "^(..)(..)(..)(..)(..)(..)(..)(..)$", "$8$7$6$5$4$3$2$1"))


def counted(value: Column) -> Column:
    """A value after its length as eight little-endian bytes."""
    return F.concat(le64(F.octet_length(value)), value.cast("binary"))


def request_hash(namespace: Column, stream: Column, expected: Column, request_id: Column, records: Column) -> Column:
    """SHA-256 of what a request asks for, in a fixed order. Producer, times and ids stay out; header order doesn't matter."""
    heads = lambda r: F.aggregate(canonical(r["headers"]), F.unhex(F.lit("")), lambda a, h: F.concat(a, counted(h["key"]), counted(h["value"])))
    body = F.aggregate(records, F.unhex(F.lit("")), lambda a, r: F.concat(a, counted(heads(r)), counted(r["payload"])))
    return F.sha2(F.concat(counted(F.lit(DOMAIN)), counted(namespace), counted(stream), counted(expected.cast("string")), counted(request_id), body), 256)


def producer(tenant: Column, service: Column, instance: Column) -> Column:
    return F.concat_ws("/", tenant, service, instance)


def uuid_hex(text: Column) -> Column:
    """The 32 hex digits of a UUID; null if malformed or zero."""
    bare = F.lower(F.regexp_replace(text, "-", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$") & (bare != "0" * 32), bare)
