"""Readable pattern grammars over text, as Spark columns, tables, files and streams."""
