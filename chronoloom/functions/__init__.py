"""Values, keys and their codecs."""
