"""Frames over the supplied tables, registered queries and their SQL."""
