"""Table operators that Spark does not have built in."""
