"""Stateful and temporal operators: admission by sliding logs, retention, event logs."""
