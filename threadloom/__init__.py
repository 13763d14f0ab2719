"""threadloom: a conversational-memory analytics engine written as Spark DataFrame plans."""
