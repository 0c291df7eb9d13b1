"""One module per log format: a score for sampled lines and a parse of one line, both column expressions."""
