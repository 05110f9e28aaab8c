"""Operators for preparing training data: ten of them, their registered queries and the SQL twins."""
