"""Adapter views, named pipelines and registered queries."""
