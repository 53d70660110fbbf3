"""Chains of operators from a declarative specification, and the registered queries."""
