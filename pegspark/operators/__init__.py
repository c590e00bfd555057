"""Operators on DataFrames."""

from .search import format_results, hits, search_hits, search_lines

__all__ = ["format_results", "hits", "search_hits", "search_lines"]
