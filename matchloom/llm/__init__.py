"""Training-data operators: search, scoring, fixity, filtering, packing, mixing, sketches, PII, licences, near-dedup.

Nothing outside this subpackage imports it.
"""
