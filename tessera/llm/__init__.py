"""Training-data operators: licences, decontamination, sharding, media, quality, BPE, near-duplicates,
toxicity, chat transcripts and line de-duplication. Nothing outside this subpackage imports it."""
