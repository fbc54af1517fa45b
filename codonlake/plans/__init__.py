"""Query plans: one function (spark, sf_dir) -> DataFrame for each registered query."""
