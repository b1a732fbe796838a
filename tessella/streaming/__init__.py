"""Running moments over streams."""
