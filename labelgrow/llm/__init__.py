"""Operations of a training-data pipeline: identification, deduplication, filters, tokens, archives."""
