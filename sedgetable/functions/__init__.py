"""Named column expressions shared by the operators."""
