"""Resumable ingestion: new files only, exactly once, until none is left."""
