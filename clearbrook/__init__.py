"""Data cleaning, privacy and text extraction as Spark DataFrame operators."""
