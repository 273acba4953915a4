"""Plan shapes shared by operators: hot-key ranges, bounded groups, rejects."""
