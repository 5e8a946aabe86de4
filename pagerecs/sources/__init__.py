"""Scans, sinks, catalog tables and derived inputs."""
