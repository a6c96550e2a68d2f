"""Jobs composed from operators: preparation, models, online response, search, scenarios."""
