"""Operators over relations: memoization, scheduling, metrics, sets, the runtime around them."""
