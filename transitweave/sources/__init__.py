"""Where transit tables come from."""
