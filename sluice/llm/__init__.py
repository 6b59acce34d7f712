"""Operators for training-data pipelines.

Each module holds one operator with its own general interface; ``queries``
registers one thin query per operator.  Nothing else in ``sluice`` imports
this package.
"""
