"""sitesmith: a Spark-native analytics engine for outdoor-site design data."""
