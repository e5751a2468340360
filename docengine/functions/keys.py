"""Storage keys: collection and id joined by the first colon, as UTF-8 bytes, and their hexadecimal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_collection(name: str) -> str:
    """A collection's name may not hold the separator, or two documents could share a key."""
    if not name or ":" in name:
        raise ValueError(f"not a collection name: {name!r}")
    return name


def encode_key(collection: Column, doc_id: Column) -> Column:
    return F.encode(F.concat(collection, F.lit(":"), doc_id), "UTF-8")


def decoded_key(key: Column) -> Column:
    """The key's text; null if its bytes are no UTF-8."""
    return F.try_validate_utf8(key.cast("string"))


def collection_of(key: Column) -> Column:
    """What stands before the first colon; null without a colon or if the bytes are no UTF-8."""
    text = decoded_key(key)
    return F.when(F.instr(text, ":") > 0, F.substring_index(text, ":", 1))


def id_of(key: Column) -> Column:
    """What stands after the first colon, further colons included."""
    text = decoded_key(key)
    at = F.instr(text, ":")
    return F.when(at > 0, F.substring(text, at + 1, F.length(text)))


def in_collection(key: Column, collection: str) -> Column:
    return F.startswith(key, F.encode(F.lit(f"{check_collection(collection)}:"), "UTF-8"))


def to_hex(key: Column) -> Column:
    return F.lower(F.hex(key))


def from_hex(text: Column) -> Column:
    """Null if the text is no hexadecimal number of whole bytes."""
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))


def epoch_seconds(when: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, as a double."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), when) / F.lit(1e6)
