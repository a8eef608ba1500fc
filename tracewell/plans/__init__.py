"""Named queries: operators over canonical tables, each with its oracle SQL."""
