"""Identities of graph rows: plain functions, and the same rules as column expressions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha1(*parts: object) -> str:
    return hashlib.sha1("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


def made(kind: str, *parts: object) -> str:
    return f"{kind}:{sha1(*parts)}"


def rank(*parts: object) -> int:
    """The first 15 hex digits of the SHA-1, as a number: an edge's stable key beside its ends."""
    return int(sha1(*parts)[:15], 16)


def normal_expression(sql: str) -> str:
    return re.sub(r"\s+", " ", sql).strip().lower()


def normal_identifier(name: str) -> str:
    return name.strip().replace("`", "").lower()


def normal_column(name: str) -> str:
    return re.sub("[`\"']", "", name).rsplit(".", 1)[-1].strip()


def table_id(name: str) -> str:
    return f"table:{name}"


def _joined(parts: tuple[Column, ...]) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def made_column(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.sha1(_joined(parts)))


def rank_column(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha1(_joined(parts)), 1, 15), 16, 10).cast("bigint")


def normal_expression_column(sql: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(sql, r"\s+", " ")))


def normal_identifier_column(name: Column) -> Column:
    return F.lower(F.replace(F.trim(name), F.lit("`"), F.lit("")))
