"""Tessera: grounded-episode analytics and corpus preparation, expressed as Spark plans."""
