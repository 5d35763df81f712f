"""Training-data operators: near-duplicates, packing, classifiers, PII, search and mixing.

Nothing outside this subpackage imports it; it can be deleted without touching the rest.
"""
