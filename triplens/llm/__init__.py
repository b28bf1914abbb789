"""Operations on training text: extraction, filtering, deduplication, mixing, sharding and tokenization."""
