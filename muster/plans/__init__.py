"""Composed jobs: what a user of the engine runs."""
