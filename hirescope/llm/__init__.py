"""Training-data operators: scoring, near-dedup, search, tokenizing, mixing.

Nothing else in the package imports this subpackage; its queries and SQL are
in ``hirescope.llm.queries``.
"""
