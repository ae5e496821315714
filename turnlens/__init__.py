"""Spark-first analytics for task-oriented dialogues: detection, explanation, profiles and reports."""
