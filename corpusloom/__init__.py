"""A PySpark engine that turns raw text into the token blocks of a language model."""
