"""Spark jobs for curating large catalogs of repositories and their READMEs."""
