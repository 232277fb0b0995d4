"""Table operators as DataFrame-to-DataFrame functions."""
