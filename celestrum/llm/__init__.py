"""Training-data operators: URL filters, language-model scoring, decontamination, deduplication, packing, sharding, quality, search, extraction.

Nothing outside this subpackage imports it.
"""
