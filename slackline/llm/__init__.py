"""Operators for preparing training text: tokenizing, sharding, deduplication, filtering and packing.

Nothing outside this subpackage imports it; ``slackline.llm.queries`` lists its queries.
"""
