"""Iterative plans: rounds of DataFrame joins with durable intermediates."""
