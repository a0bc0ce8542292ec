"""Training-data operators: classifiers, archives, sharding, dedup, packing, extraction.

Nothing else in the library imports this subpackage.
"""
