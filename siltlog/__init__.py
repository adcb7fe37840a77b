"""siltlog: a Spark-native analytics engine for web-server access logs."""
