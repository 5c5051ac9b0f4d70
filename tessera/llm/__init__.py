"""Operations of a training-data pipeline: near-duplicate and substring dedup,
tokenisation, fingerprints, page extraction, mixing, packing, scoring, rules.

Each module holds one operator; ``registry`` holds the thin ``opN_<name>``
queries and their oracle SQL. Nothing else in the library imports this package.
"""
