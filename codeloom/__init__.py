"""codeloom: repository intelligence and corpus analytics as Spark DataFrame operators."""
