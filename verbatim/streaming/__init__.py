"""Row-level operators over streams."""
