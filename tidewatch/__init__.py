"""tidewatch: table quality, incremental loads and run analytics as PySpark DataFrame operators."""
