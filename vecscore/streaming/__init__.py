"""Scoring of a stream of payloads."""
