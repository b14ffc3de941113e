"""What-if analyses and shadow diagnostics over recorded plans."""
