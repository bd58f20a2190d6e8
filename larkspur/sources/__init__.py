"""Input tables: captured pages, retailers, catalogue, settings."""
