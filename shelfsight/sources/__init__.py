"""Schemas, readers, writers and the driver-table adapters."""
