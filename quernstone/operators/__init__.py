"""Operators: guarded execution, comparison, voting, dataset building, evaluation, schema, questions."""
