"""Compact guids and digest keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_guid(guid: Column) -> Column:
    """Unsigned 64-bit decimal text to 11 characters of url-safe base64, ``_`` written as ``:``."""
    raw = F.unhex(F.lpad(F.conv(guid, 10, 16), 16, "0"))
    return F.translate(F.base64(raw), "+/=", "-:")


def decimal_guid(compact: Column) -> Column:
    """Inverse of :func:`compact_guid`."""
    raw = F.unbase64(F.concat(F.translate(compact, "-:", "+/"), F.lit("=")))
    return F.conv(F.hex(raw), 16, 10)


def sha_key(value: Column, parts: int = 1) -> Column:
    """SHA-256 as unpadded url-safe base64; ``parts`` 2 or 3 keeps the first half or third of the 43 characters."""
    digest = F.translate(F.base64(F.unhex(F.sha2(value, 256))), "+/=", "-_")
    return F.substring(digest, 1, 43 // parts)


def state_key(namespace: Column, dataset: Column, *label: Column) -> Column:
    """Key of a refresh-state row: digest of namespace / dataset, then digests of the label or filter set."""
    pieces = [sha_key(namespace), sha_key(dataset)] + [sha_key(part, 2) for part in label]
    return F.concat_ws("/", *pieces)


def replication_state_key(
    namespace: Column, dataset: Column, dst_namespace: Column, dst_dataset: Column, filters: Column
) -> Column:
    """Replication state is only valid for one destination and one filter set, so both are part of the key."""
    return F.concat_ws(
        "/",
        sha_key(namespace),
        sha_key(dataset),
        F.lit("=="),
        sha_key(dst_namespace, 3),
        sha_key(dst_dataset, 3),
        sha_key(filters, 3),
    )
