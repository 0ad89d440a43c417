"""Models over streams."""
