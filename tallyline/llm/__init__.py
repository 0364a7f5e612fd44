"""Operators of a training-data pipeline: filters, deduplication, mixing, packing, search.

Nothing outside this folder imports it. Executors need the package too, like
any Python code that runs there (`--py-files`, or installed).
"""
