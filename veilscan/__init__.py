"""Spark jobs that scan large document collections for hidden content."""
