"""Operations for preparing large training corpora: search, filtering, deduplication, packing."""
