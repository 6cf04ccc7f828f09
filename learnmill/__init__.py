"""learnmill: learning-analytics and corpus operators as plain Spark DataFrame functions."""
