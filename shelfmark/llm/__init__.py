"""Training-data operators: packing, classifiers, language-model scores, fingerprints, deduplication and extraction.

Nothing else in the library imports this subpackage.
"""
