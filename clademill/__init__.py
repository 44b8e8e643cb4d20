"""Clademill: phylogenetic analytics as Spark jobs."""
