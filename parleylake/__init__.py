"""Spark-first analytics over chat-log tables: paging, identity, assets, audits, decoders and table-shaping operators."""
