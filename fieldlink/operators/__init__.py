"""DataFrame operators: dictionary, profiles, types, overlap, duplicates, decisions, review."""
