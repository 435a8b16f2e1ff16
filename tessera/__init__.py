"""tessera: relational operators over Parquet star schemas, expressed as Spark plans."""
