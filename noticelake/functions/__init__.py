"""Column expressions: text, dates, ids, urls, selectors."""
