"""DataFrame -> DataFrame operators keyed by scan / site."""
