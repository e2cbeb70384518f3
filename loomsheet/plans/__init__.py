"""The join graph and the planner."""
