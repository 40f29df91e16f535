"""Shared plan shapes: long form, contingency statistics, exact quantiles, ordered running totals."""
