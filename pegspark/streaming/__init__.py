"""Search in streams of lines."""

from .lines import number_lines, numbered_writer, search_numbered, search_stream

__all__ = ["number_lines", "numbered_writer", "search_numbered", "search_stream"]
