"""Readers that turn logs, exports and snapshots into the event and snapshot tables."""
