"""Operators of a training-data pipeline: one module each, registered in ``queries``.

Nothing else in the library imports this subpackage.
"""
