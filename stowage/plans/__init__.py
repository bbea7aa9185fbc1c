"""Whole runs composed of operators, sources and sinks."""
