"""Training-data operators: mixing, tokenising, deduplication, classifiers, search.

Nothing else in the library imports this subpackage.
"""
