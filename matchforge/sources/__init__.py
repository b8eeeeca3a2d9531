"""Readers, shredders and sinks."""
