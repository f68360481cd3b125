"""Training-data operators: packing, quality, near-duplicates, token files,
toxicity, fingerprints, URL decisions, decontamination, repeated passages,
language-model scores, embedding whitening, exact duplicates and conversation
tries. Nothing else in the library imports this subpackage."""
