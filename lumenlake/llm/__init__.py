"""Training-data operators: PII, licences, secrets, mixing, toxicity, dedup, quality, tokens, decontamination."""
