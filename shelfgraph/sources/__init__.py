"""Where graphs and pages come from, and where graphs go."""
