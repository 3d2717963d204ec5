"""Operators over bibliographic records, edges, decisions and effects."""
