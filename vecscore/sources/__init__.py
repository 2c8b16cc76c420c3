"""Schemas and readers of labelled records, payloads, constants and stored indexes."""
