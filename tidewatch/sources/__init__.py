"""Readers and writers: feeds, exports, archives, pages and snapshots."""
