"""Training-data operators: deduplication, packing, tokenising, language, quality, media and web archives.

Nothing outside this subpackage imports it.
"""
