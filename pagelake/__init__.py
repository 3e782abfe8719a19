"""pagelake: collections of PDF documents as relational tables, on Spark."""
