"""The same filters over streams."""
