"""bitloom: a Spark-native engine for entropy-coded weight tensors and corpus preparation."""
