"""Readers of irregular CSV and JSON Lines, and the writers of a run's results."""
