"""Collections as tables: lists (pos, value), sets (value), maps (key, value), ordered maps and sets, deques.

Bulk operations are functions from DataFrames to DataFrames. The classes are handles on a current
DataFrame: a mutator computes a new one and raises the version; views and iterators read through
the handle.
"""
