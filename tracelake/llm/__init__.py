"""Training-data operators: each module is one operator with its query and, where SQL can say it, its SQL."""
