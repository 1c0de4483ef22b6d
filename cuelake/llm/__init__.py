"""Training-data operators over whole corpora; nothing outside this subpackage imports it."""
