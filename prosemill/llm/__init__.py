"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames and keeps no state on the driver beyond bounded models.
"""
