"""hamsieve: build, classify, evaluate and explain mail corpora on Spark."""
