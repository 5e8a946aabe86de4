"""DataFrame -> DataFrame steps of the published jobs."""
