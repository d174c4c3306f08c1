"""Operators of a training-data pipeline.

One module per operator; ``registry`` holds their registered queries and SQL.
Nothing else in the library imports this package.
"""
