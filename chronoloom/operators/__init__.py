"""Temporal operators as DataFrame programs."""
