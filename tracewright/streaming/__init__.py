"""Streaming deployments of the operators."""
