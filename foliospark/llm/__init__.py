"""Operators of a training-data pipeline: deduplication, packing, filtering, scanning and tokenization.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; `queries` binds them to the tables of a data folder.
"""
