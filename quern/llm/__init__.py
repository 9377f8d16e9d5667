"""Training-data operators: token counts, license scan, decontamination, packing,
line dedup, media columns, quality classifier, n-gram join, substring dedup, PII.

Nothing outside this sub-package imports it.
"""
