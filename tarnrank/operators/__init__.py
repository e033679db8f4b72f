"""Relational operators: aggregates, itemsets, similarity, neighbours, factorisation, evaluation."""
