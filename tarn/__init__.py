"""tarn: Spark-native analysis of field incubations, site chemistry and ecological communities."""
