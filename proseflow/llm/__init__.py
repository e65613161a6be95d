"""Training-data operators: deduplication, quality, language, extraction, tokens and packing.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin ``opN_<name>`` queries over the tables.
"""
