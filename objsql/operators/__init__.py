"""Object-catalog operators: DataFrame in, DataFrame out, planned by Catalyst.

Nothing here collects rows or calls Python per row. Times are parameters, so a
result can be computed again. Where two rows tie, the docstring says which wins.
"""
