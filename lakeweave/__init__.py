"""lakeweave: a PySpark-native relational analytics engine with a SQLite-flavoured SQL surface."""
