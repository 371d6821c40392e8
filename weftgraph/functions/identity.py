"""Stable ids: the first 128 bits of a SHA-256 in base 62."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of base 62 in their order (fixed value).
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int = 22) -> str:
    out = []
    while number:
        number, digit = divmod(number, 62)
        out.append(DIGITS[digit])
    return "".join(reversed(out)).rjust(width, DIGITS[0])


def derive(text: str) -> str:
    return base62(int.from_bytes(hashlib.sha256(text.encode()).digest()[:16], "big"))


def derived(text: Column) -> Column:
    """derive() of a string column; decimals have too few digits for 128 bits, so this is Python on Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else derive(x))

    return F.pandas_udf(run, T.StringType())(text)


def joined(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def root_fingerprint(root_path: Column, manifest: Column) -> Column:
    return derived(F.concat(root_path, F.lit(":"), manifest))


def file_id(fingerprint: Column, path: Column) -> Column:
    return derived(joined(fingerprint, path))


def symbol_id(file: Column, kind: Column, qualified_name: Column, ordinal: Column) -> Column:
    return derived(joined(file, "symbol", kind, qualified_name, ordinal.cast("string")))


def edge_id(source: Column, kind: Column | str, target: Column) -> Column:
    return derived(joined(source, kind, target))


def external_id(fingerprint: Column, name: Column) -> Column:
    return derived(joined(fingerprint, "external", name))


def root_id(fingerprint: Column) -> Column:
    return derived(joined("root", fingerprint))


def unresolved_id(fingerprint: Column, source: Column, specifier: Column) -> Column:
    return derived(joined(fingerprint, "unresolved", source, specifier))


def boundary_id(kind: Column, path: Column) -> Column:
    return derived(joined("architecture-boundary", kind, path))
