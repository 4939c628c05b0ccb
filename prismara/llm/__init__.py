"""Training-data operators: filters, scans, joins, mixing and sharding of text corpora.

Nothing outside this subpackage imports it.
"""
