"""forumlake: search and upkeep of a large threaded discussion corpus on Spark."""
