"""marlspike: a Spark-native engine for retrieval analytics over structured documents."""
