"""Schemas, readers, the message-log adapter and sinks."""
