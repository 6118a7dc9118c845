"""Planner actions as a stream of writes."""
