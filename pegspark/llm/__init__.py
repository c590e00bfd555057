"""Operators for preparing large text corpora; each module holds one operator."""
