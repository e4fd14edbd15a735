"""Operations on training text: deduplication, scoring, filtering, tokenising, packing and media columns.

Nothing outside this subpackage imports it.
"""
