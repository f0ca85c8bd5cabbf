"""Column builders: scalars, tiers, named measures, statistics attachment."""
