"""tessera: Spark-first operators for studying which unconnected items become connected later."""
