"""Plan-shaping helpers and end-to-end plans."""
