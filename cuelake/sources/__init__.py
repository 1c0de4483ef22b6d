"""Scans: the tables that the engine reads, and the formats that it parses."""
