"""Jobs made of the operators: map, crawl, commit, feed."""
