"""Operations of a training-data pipeline: filtering, deduplication, mixing,
sharding, tokenising, search, scoring and archives.  Nothing else in the
library imports this subpackage; ``queries.register_all`` adds its queries."""
