"""Training-data operators: ten stand-alone DataFrame operators and their queries."""
