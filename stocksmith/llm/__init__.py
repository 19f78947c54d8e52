"""Training-data operators on whole corpora: quality, secrets, duplicates, URLs,
search, tokens and packing.  Nothing outside this folder imports it."""
