"""Plans over whole corpora: snapshots, profiles, the engine."""
