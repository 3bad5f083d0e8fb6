"""Identities and hashes of content."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_id, col


def sha_prefix(c: Column | str, n: int = 16) -> Column:
    return F.substring(F.sha2(col(c).cast("string"), 256), 1, n)


def identity_text(cls: str, fields: dict[str, Column | str], numbers: Collection[str] = ()) -> Column:
    """field=canonical pairs in the order of the names, after the class. numbers: the fields that are whole numbers."""
    return F.concat_ws("|", F.lit(cls), *(F.concat(F.lit(f"{k}="), canonical_id(k, fields[k], k in numbers)) for k in sorted(fields)))


def node_id(cls: str, fields: dict[str, Column | str], numbers: Collection[str] = ()) -> Column:
    """Class_ and 16 hex digits of SHA-256 over the canonical identity, wholly in the JVM."""
    return F.concat(F.lit(f"{cls}_"), sha_prefix(identity_text(cls, fields, numbers)))


def compatible_node_id(cls: str, fields: list[str]) -> Column:
    """Class_ and 16 hex digits of BLAKE2b over the sorted JSON of the canonical identity, for graphs whose ids others made so."""

    @F.pandas_udf("string")
    def digest(pdf: pd.DataFrame) -> pd.Series:
        out = [f"{cls}_{hashlib.blake2b(json.dumps({**r, '__class__': cls}, sort_keys=True, default=str).encode()).hexdigest()[:16]}" for r in pdf.to_dict("records")]
        return pd.Series(out, dtype="object")

    return digest(F.struct(*(canonical_id(f, f).alias(f) for f in fields)))


def identity_key(path: str, fields: dict[str, Column | str]) -> Column:
    """path|field=value,... over the fields that aren't blank, or null if all are."""
    pairs = F.array(*(F.when(canonical_id(k, v) != "", F.concat(F.lit(f"{k}="), canonical_id(k, v))) for k, v in sorted(fields.items())))
    some = F.filter(pairs, lambda p: p.isNotNull())
    return F.when(F.size(some) > 0, F.concat(F.lit(f"{path}|"), F.array_join(some, ",")))


def identity_pairs(fields: dict[str, Column | str]) -> Column:
    """Sorted (field, canonical value) pairs that aren't blank."""
    return F.array_sort(F.filter(F.array(*(F.struct(F.lit(k).alias("field"), canonical_id(k, v).alias("value")) for k, v in fields.items())), lambda p: p["value"] != ""))


def canonical_text(fields: dict[str, Column | str]) -> Column:
    return F.concat_ws(" ", *(F.when(canonical_id(k, v) != "", canonical_id(k, v)) for k, v in fields.items()))


def content_hash(columns: list[str], node_id: Column | str | None = None) -> Column:
    """SHA-256 over name=value of the sorted columns; the node's id takes part where a value is Unknown, so such nodes stay apart."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in sorted(columns)]
    if node_id is not None:
        unknown = F.exists(F.array(*(F.col(c).cast("string") for c in columns)), lambda v: v == "Unknown")
        parts.append(F.when(F.coalesce(unknown, F.lit(False)), col(node_id)))
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def temporal(c: Column | str) -> Column:
    """A full ISO date and time with a space for its T; anything else as it is."""
    c = col(c).cast("string")
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?"), F.regexp_replace(c, "T", " ")).otherwise(c)


def variant_id(node: Column | str, stamp: Column | str) -> Column:
    return F.concat(col(node), F.lit("__var_"), F.substring(col(stamp), 1, 8))


def collisions(ids, class_column: str = "class", id_column: str = "node_id"):
    """Fingerprints that more than one class has: (fingerprint, classes)."""
    fp = F.regexp_extract(id_column, r"_([0-9a-f]+)$", 1)
    return ids.groupBy(fp.alias("fingerprint")).agg(F.countDistinct(class_column).alias("classes")).filter("classes > 1")


def location(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column, grid: int = 512) -> Column:
    """A box on the page's grid, corners put in order, rounded half to even, within 0 and grid - 1."""
    q = lambda x, size: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.bround(F.lit(float(grid)) * x / size, 0).cast("int")))
    return F.array(q(F.least(l, r), width), q(F.least(t, b), height), q(F.greatest(l, r), width), q(F.greatest(t, b), height))
