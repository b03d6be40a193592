"""Micro-batch cycle, look-back windows, key dedup and idle state."""
