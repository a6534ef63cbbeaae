"""Where tables come from: typed domain tables over the star schema, crawled pages, the source registry."""
