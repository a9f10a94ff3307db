"""Jobs over many recordings at once, keyed by recording_id."""
