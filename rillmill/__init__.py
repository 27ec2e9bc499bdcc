"""Message-dataflow analytics as Spark plans."""
