"""Column functions and the building blocks that keep hot keys spread over tasks."""
