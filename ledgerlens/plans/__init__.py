"""Named feature sets and the batch jobs."""
