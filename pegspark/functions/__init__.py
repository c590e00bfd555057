"""Grammars as Spark columns."""

from .catalogue import Catalogue
from .grammar import Grammar
from .sql import register

__all__ = ["Catalogue", "Grammar", "register"]
