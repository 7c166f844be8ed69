"""Operators of a training-data pipeline: quality, de-duplication, secrets, token work, sharding.

Nothing outside this package imports it.
"""
