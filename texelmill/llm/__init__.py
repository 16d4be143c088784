"""Operators for training-data pipelines over tables of documents, pages, conversations and embeddings.

Nothing outside this package imports it. ``queries`` holds the named queries, one module each operator:
``mixing`` (1), ``bpe`` (2), ``ngram_join`` (3), ``topk`` (4), ``langid`` (5), ``substrings`` (6), ``chat`` (7), ``pages`` (8),
``lines`` (9), ``fingerprints`` (10).
"""
