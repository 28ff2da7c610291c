"""Features, models and custom pipeline stages."""
