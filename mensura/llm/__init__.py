"""Operators for preparing training data: tokens, texts, near copies, mixing,
sharding and packing. Nothing outside this package imports it; its queries are
in ``mensura.llm.catalog``.
"""
