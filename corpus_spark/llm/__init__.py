"""Training-data operators: dedup, decontamination, mixing, search, filters, chat, scoring."""
