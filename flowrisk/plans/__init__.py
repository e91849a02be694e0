"""Compositions of operators: parameterised jobs and the registered queries."""
