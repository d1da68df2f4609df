"""roadtide: travel-time analytics and training-data preparation as Spark DataFrame operators."""
