"""Where texts come from: folders, text tables, version history, baselines, settings."""
