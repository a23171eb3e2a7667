"""quadflow: RDF quads, graph patterns and SPARQL 1.0 on Spark DataFrames."""

__version__ = "0.1.0"
