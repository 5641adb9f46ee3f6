"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general DataFrame-in, DataFrame-out interface; ``queries``
derives the thin contract queries from them.
"""
