"""Question-bank processing on Spark: items, rules, reports, line streams and grading as DataFrame plans."""
