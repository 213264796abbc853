"""Operators on tables: numbering, keys, joins, unpivoting, columns, summaries."""
