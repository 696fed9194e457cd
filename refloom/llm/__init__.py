"""Training-data operators: dedup, filtering, formatting, mixing and scanning of text corpora.

Nothing else in the library imports this subpackage.
"""
