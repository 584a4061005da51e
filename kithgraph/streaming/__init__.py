"""No graph operator reads a stream; exact deduplication of texts does (``llm/dedup_exact.py``)."""
