"""maskwright: find, review and mask personal data in text with Spark."""
