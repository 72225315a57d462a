"""Column functions: event codecs, envelopes."""
