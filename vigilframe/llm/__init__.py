"""Training-data operators: search, quality, mixing, archives, toxicity, language, duplicates, packing and licence scans."""
