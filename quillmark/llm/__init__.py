"""Training-data operators: dedup, extraction, archives, privacy, packing, quality and language.

Nothing outside this subpackage imports it."""
