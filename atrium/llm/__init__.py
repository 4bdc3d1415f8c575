"""Training-data operators: archives, deduplication, retrieval, text extraction and mixing.

Nothing outside this subpackage imports it.
"""
