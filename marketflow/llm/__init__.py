"""Operations of a training-data pipeline: tokens, secrets, quality, near-duplicates, URLs, mixing, language, search."""
