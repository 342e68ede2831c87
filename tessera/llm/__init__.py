"""Operators for large-scale training-data preparation.

Each module is one operator with its own general interface; ``queries`` holds
the thin ``opN_*`` queries registered for the driver's tables. Nothing else in
the library imports this sub-package.
"""
