"""Classification by ordered decision lists over markers."""
