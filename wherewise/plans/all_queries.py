"""Imports all modules that register queries."""

from . import q_bench, q_geometry, q_io, q_more, q_rank, q_relations, q_resolver, q_text  # noqa: F401
from .catalog import QUERIES, SQL  # noqa: F401
