"""Training-data operators: deduplication, language, mixing, quality, archives, tokens.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
