"""Column functions: text, HTML, URLs, languages, queries."""
