"""Operators for building training corpora: dedup, quality, mixing, packing, tokens, archives.

Nothing outside this package imports it; the queries over the driver's tables are in ``queries``.
"""
