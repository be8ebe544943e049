"""Kinds of nodes and edges and what they are compared by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edge kinds in the order of their numbers, which is their sort order.
EDGE_KINDS = (
    "contains", "declares", "imports", "exports", "calls", "reads", "writes", "implements", "extends", "overrides", "references",
    "uses_type", "returns_type", "accepts_type", "routes_to", "handled_by", "tests", "covers", "produces_job", "consumes_job",
    "reads_config", "writes_config", "reads_table", "writes_table", "depends_on", "throws", "catches", "serializes", "deserializes",
    "validates", "authorizes", "publishes", "subscribes",
)
# Reverse views, which are in-edges of a stored kind.
REVERSE_VIEWS = {"called_by": "calls", "depended_on_by": "depends_on", "tested_by": "tests"}
# What resolved a reference, by number.
RESOLVED_BY = ("structural", "import", "this_member", "di_constructor", "type_annotation", "name_unique", "name_ambiguous", "framework", "type_checker", "heuristic")


def kind_number(kind: Column) -> Column:
    """The sort number of an edge kind; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, EDGE_KINDS)), kind), F.lit(0)).cast("int") - 1


def edge_filter(kinds: list[str] | None = None, floor: int = 0) -> Column:
    """Edges of some kinds (None: all) with a least confidence."""
    out = F.col("confidence") >= floor
    return out if kinds is None else out & F.col("kind").isin(*kinds)


def selector_filters(selectors: list[str], floor: int = 0) -> tuple[Column, Column]:
    """Names of stored kinds and reverse views, split into a filter of out-edges and one of in-edges."""
    return edge_filter([s for s in selectors if s in EDGE_KINDS], floor), edge_filter([REVERSE_VIEWS[s] for s in selectors if s in REVERSE_VIEWS], floor)
