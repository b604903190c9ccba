"""Operations of a training-data pipeline: license scan, near-dedup, quality
classifier, URL filter, exact and approximate vector search, source mixing,
sharding, chat formatting and sequence packing. Nothing else in the library
imports this subpackage; ``queries`` holds its registered queries."""
