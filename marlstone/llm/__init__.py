"""Training-data operators: packing, archives, decontamination, scoring, joins.

Nothing else in the library imports this subpackage; ``catalog`` lists its
queries and their SQL.
"""
