"""Training-data operators: deduplication, scoring, extraction, decontamination and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
