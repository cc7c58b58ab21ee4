"""The stateful operators and event-time windows on streams."""
