"""Operators of a training-data pipeline over document, page and vector tables.

Each module holds one operator; ``registry`` holds their queries.  Nothing
outside this subpackage imports it.
"""
