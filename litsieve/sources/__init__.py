"""Readers and connectors for bibliographic payloads."""
