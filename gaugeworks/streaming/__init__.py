"""Stateful processing of frame streams."""
