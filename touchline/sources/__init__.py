"""Scans and sinks: XML fixtures, standings and statistics, keyed stores, exports."""
