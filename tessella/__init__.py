"""tessella: a Spark-native engine for building, searching and evaluating linked text collections."""
