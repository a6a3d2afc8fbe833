"""Operators of a large-scale training-data pipeline.

Each module holds one operator with a general interface (``f(DataFrame, ...) ->
DataFrame``); ``queries.py`` holds the thin registered queries over the test tables and
``oracles.py`` the SQL they are compared with.  Nothing else in the library imports
this subpackage.
"""
