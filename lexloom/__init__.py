"""lexloom: corpus analytics for long-document text collections on Spark."""
