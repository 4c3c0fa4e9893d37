"""The daily run as a stream over landed payloads."""
