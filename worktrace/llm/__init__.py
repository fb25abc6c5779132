"""Training-data operators: cleaning, deduplication, classification, mixing, packing and WARC derivatives.

Nothing else in the package imports this one; its queries are in ``worktrace.llm.queries``.
"""
