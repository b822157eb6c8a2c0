"""Incremental arrival of the daily inputs."""
