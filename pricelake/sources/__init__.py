"""Readers and writers: feed payloads, price history, archives, exports."""
