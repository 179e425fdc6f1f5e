"""Event-anchored signal and rater-agreement analytics as lazy Spark plans."""
