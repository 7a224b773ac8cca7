"""Compositions of operators into whole jobs, and the registered queries."""
