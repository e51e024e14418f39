"""Node identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of 32-bit FNV-1a.
FNV_START, FNV_PRIME = 2166136261, 16777619


def merge_uid(label: str, **keys: Column | str) -> Column:
    """``Label||k1=v1||k2=v2`` with keys in order; a null value counts as empty."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit(""))) for k, v in sorted(keys.items())]
    return F.concat_ws("||", F.lit(label), *parts)


def hash_uid(label: Column, name: Column, file: Column) -> Column:
    """16 hex digits of sha256 over label, name and file."""
    return F.substring(F.sha2(F.concat_ws("::", label, F.coalesce(name, F.lit("")), F.coalesce(file, F.lit(""))), 256), 1, 16)


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the characters' codes (ASCII), as a long."""
    start = F.lit(FNV_START).cast("long")
    return F.aggregate(F.split(text, ""), start, lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME).cast("long") % F.lit(1 << 32).cast("long"))


def segment(text: Column) -> Column:
    """The low 16 bits of the hash as four hex digits."""
    return F.lower(F.lpad(F.hex(fnv1a32(text).bitwiseAND(F.lit(0xFFFF).cast("long"))), 4, "0"))


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def occurrence_key(label: Column, name: Column, file: Column, nth: Column) -> Column:
    """The key by which two snapshots are compared; later ones of a name get #k."""
    base = F.concat_ws("|", label, name, F.coalesce(file, F.lit("")))
    return F.when(nth > 0, F.concat(base, F.lit("#"), nth.cast("string"))).otherwise(base)
