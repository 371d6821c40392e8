"""Tables of many repositories: where all tables of an operator have repo_id, it works within each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPOSITORY = "repo_id"


def scope(*tables: DataFrame | None) -> list[str]:
    """The columns that an operator's keys begin with: repo_id if all tables have it, none if none has."""
    has = {REPOSITORY in t.columns for t in tables if t is not None}
    if has == {True, False}:
        raise ValueError("repo_id is in some of the tables only")
    return [REPOSITORY] if True in has else []


def node_of(g: list[str], path: Column) -> Column:
    """One name for a path in its repository, as fixpoints over all repositories at once need it."""
    return F.concat(*g, F.lit("\x00"), path) if g else path
