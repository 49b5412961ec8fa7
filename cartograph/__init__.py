"""Code-graph analytics on Spark: sources in, graph tables out, graph queries over them."""
