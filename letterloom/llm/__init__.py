"""Training-data operators: text and vector deduplication, classification, search, formatting,
tokenisation, packing and archiving.

Nothing outside this subpackage imports it; the registered queries are in ``queries``.
"""
