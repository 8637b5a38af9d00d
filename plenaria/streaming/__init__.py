"""Stateful counters and anchored windows."""
