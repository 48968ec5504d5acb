"""Training-data operators: PII, quality, tokens, packing, dedup, search, URLs, languages, licences.

Each module holds one operator with a general interface; ``queries`` applies
them to the standard tables and derives the contract's digest columns.
Nothing outside this subpackage imports it.
"""
