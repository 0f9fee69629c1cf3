"""turnwise: analytics over collections of small attributed graphs that are edited turn by turn, on Spark."""
