"""Ready-made plans over the star-schema and event tables."""
