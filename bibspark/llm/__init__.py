"""Training-data operators: mixing, deduplication, LM scoring, PII, toxicity, fingerprints, packing.

Nothing else in the package imports this subpackage.
"""
