"""The query language: text to syntax tree to Column."""
