"""Training-data operators (numbered 1-13) and their registered queries."""
