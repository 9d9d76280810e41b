"""Looking at physical plans: what reaches the scan, and what is exchanged."""
