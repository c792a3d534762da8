"""Scope paths: segments joined by slashes, matched whole or at a segment's end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCOPE = r"^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*$"
LONGEST = 512


def normalize_scope(scope: Column) -> Column:
    return F.trim(scope)


def scope_reason(scope: Column) -> Column:
    """Why a scope is not valid, or null."""
    s = normalize_scope(scope)
    return (
        F.when(s.isNull() | (s == ""), "empty")
        .when(F.octet_length(s) > LONGEST, "too_long")
        .when(s.rlike(r"\s"), "white_space")
        .when(F.contains(s, F.lit("//")) | s.startswith("/") | s.endswith("/"), "empty_segment")
        .when(~s.rlike(SCOPE), "bad_character")
    )


def scope_match(stored: Column, asked: Column, mode: Column) -> Column:
    """Equal, or under the asked scope at a segment's end where ``mode`` is ``prefix``."""
    return (stored == asked) | ((mode == "prefix") & stored.startswith(F.concat(asked, F.lit("/"))))


def ancestors(scope: Column) -> Column:
    """The scope and every scope above it."""
    parts = F.split(scope, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scope_root(scope: Column) -> Column:
    """The first two segments: the unit of storage."""
    return F.substring_index(scope, "/", 2)
