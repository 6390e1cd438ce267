"""Whole jobs composed of the operators: evaluation, audits and reports."""
