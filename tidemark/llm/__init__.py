"""Training-data operators: fingerprints, duplicate search, decontamination, language and quality models, tokenisation, secrets."""
