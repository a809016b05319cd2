"""Descriptor-catalogue analytics on Spark: typed records, validation, search, ordering, similarity, comparison, layout."""
