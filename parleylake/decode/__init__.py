"""Decoders of binary chat payloads, as plain functions on bytes and as Spark columns and tables."""
