"""Operators for preparing large text corpora: de-duplication, archives, tokens, packing, classifiers, search.

Nothing else in the library imports this subpackage.
"""
