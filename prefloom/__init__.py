"""Preference-data engine on Spark: transcripts, judging, match-ups, rollouts, run logs."""

__version__ = "0.1.0"
