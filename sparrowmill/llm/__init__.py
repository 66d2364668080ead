"""Training-data operators: tokenising, media columns, deduplication, packing, search, language id.

Nothing else in the library imports this subpackage; ``llm.registry`` lists its queries.
"""
