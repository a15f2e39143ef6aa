"""Set-oriented jobs over catalog, document, event and vector tables."""
