"""Pluggable models.  Everything works offline; real models are registered by the user."""
