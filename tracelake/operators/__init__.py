"""DataFrame operators over session, usage, call, corpus and catalog tables."""
