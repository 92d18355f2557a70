"""Column functions: strands, statuses, motifs, bins and number formats."""
